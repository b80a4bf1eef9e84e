"""Ordered streams, resolver lines, graphs and diagnosis on small synthetic logs."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import conflicts, ordered, resolver_lines, rules, similarity, terminal
from lodestone.plans import diagnosis, report

MAIN = """2026-04-25 10:00:00,000 INFO Using config files '[...]'
2026-04-25 10:00:01,500 DEBUG openCache()
2026-04-25 10:00:02,000 DEBUG Foreign (before rewriting sources): libppa
2026-04-25 10:00:03,000 DEBUG running doUpdate() (showErrors=False)
2026-04-25 10:00:04,000 ERROR doUpdate() failed completely
2026-04-25 10:00:05,000 DEBUG running doUpdate() (showErrors=True)
2026-04-25 10:00:06,000 DEBUG openCache()
2026-04-25 10:00:07,000 ERROR Dist-upgrade failed: E:Error, pkgProblemResolver::Resolve generated breaks, this may be caused by held packages.
 continued
2026-04-25 10:00:08,000 DEBUG abort called"""

APT = """Log time: 2026-04-25 10:00:06
Starting pkgProblemResolver with broken count: 2
Investigating (0) liba:amd64 < 1 -> 2 @ii umU Ib >
Broken liba:amd64 Depends on libb:amd64 < none | 3 @un umH > (>= 3)
  Considering libb:amd64 4 as a solution to liba:amd64 5
  Holding Back liba:amd64 rather than change libb:amd64
Broken libc:amd64 Depends on liba:amd64 < 1 -> 2 @ii umU Ib > (= 2)
Broken libppa:amd64 Conflicts on libd:amd64 < 1 @ii K > (< 2)
Broken libd:amd64 Breaks on libppa:amd64 < 9 @ii mK > (< 2)
 a line of no known phrase
Done
Log time: 2026-04-25 10:00:06
Starting pkgProblemResolver with broken count: 0
Done"""

TERM = """Log started: 2026-04-25  10:00:00
Setting up libx (1.0) ...
error running python rtupdate hook llvm-21-tools
dpkg: error processing package python3 (--configure):
 /usr/lib/x.py:3: SyntaxWarning: invalid escape
 installed python3 package post-installation script subprocess returned error exit status 4
dpkg: error processing package idle (--configure):
 dependency problems - leaving unconfigured
dpkg: error processing archive /tmp/b.deb (--unpack):
 trying to overwrite '/usr/bin/b', which is also in package c 1.0
Errors were encountered while processing:
 python3
 idle
E: Sub-process /usr/bin/dpkg returned an error code (1)
Log ended: 2026-04-25  10:01:00"""


def lines(spark, **sources):
    rows = [("r1", s, i + 1, x) for s, text in sources.items() for i, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "run_key string, source string, line_no int, line string")


def one(spark, source, text):
    return lines(spark, **{source: text}).drop("source")


def test_records_fold_and_phases_never_go_back(spark):
    rec = ordered.fold_records(one(spark, "main", "tail of another\n" + MAIN))
    rows = ordered.running_phase(rec, ordered.phase_of(F.col("message")), ["run_key"], ["seq"]).orderBy("seq").collect()
    assert len(rows) == 9 and rows[0]["line_no"] == 2 and rows[0]["t_ms"] == 0 and rows[1]["t_ms"] == 1500
    assert rows[7]["continuation"] == [" continued"]
    assert [r["phase"] for r in rows] == [10, 25, 25, 35, 35, 50, 50, 50, 50]


def test_month_end(spark):
    text = "2026-01-31 23:59:59,000 INFO a\n2026-02-01 00:00:00,000 INFO b"
    assert [r["t_ms"] for r in ordered.fold_records(one(spark, "main", text)).orderBy("seq").collect()] == [0, 1000]
    assert [r["t_ms"] for r in ordered.fold_records(one(spark, "main", text), calendar=False).orderBy("seq").collect()] == [0, 0]


def test_lines_are_told_apart(spark):
    tokens = {r["line_no"]: r for r in resolver_lines.lex(one(spark, "apt", APT)).collect()}
    assert [tokens[i]["verb"] for i in range(1, 12)] == ["log_time", "starting", "investigating", "broken", "considering", "holding_back", "broken", "broken", "broken", "unknown", "done"]
    b = tokens[4]
    assert (b["subject"], b["object"], b["dep"], b["constraint"], b["states"][0]["cand_version"]) == ("liba:amd64", "libb:amd64", 6, ">= 3", "3")
    assert tokens[5]["score_src"] == 4 and tokens[5]["score_dst"] == 5 and tokens[5]["depth"] == 2 and tokens[2]["broken_count"] == 2
    cov = resolver_lines.coverage(resolver_lines.lex(one(spark, "apt", APT))).first()
    assert cov["unmatched"] == 1 and cov["lines"] == 14 and abs(cov["coverage"] - 13 / 14) < 1e-9


PHRASED = [
    ("Upgrading: a due to b Depends on c < 1 > (>= 2)", "upgrading_due_to_dep", ("a", "b", "c")), ("Upgrading a due to Breaks field in b", "upgrading_due_to_field", ("a", "b", "")), ("Upgrading a due to b", "upgrading_due_to", ("a", "b", "")),
    ("Removing a rather than change b", "removing_rather", ("a", "b", "")), ("Removing a", "removing", ("a", "", "")), ("a Depends on b can't be satisfied! (dep)", "cant_be_satisfied", ("a", "b", "")), ("Installing a as Va in conflitto of b", "installing_as", ("a", "b", "")),
    ("MarkInstall a < 1 @ii K > FU=1", "mark_install", ("a", "", "")), ("Re-Instated a (1 vs -2)", "reinstated", ("a", "", "")), ("Try to Re-Instate (3) a", "try_reinstate", ("a", "", "")), ("Broken a Hängt ab von (vorher) on b", "broken", ("a", "b", "")),
    ("Broken a Depends on", "unknown", ("", "", "")),
]


def test_phrases(spark):
    lines = spark.createDataFrame([(k, line) for k, (line, _, _) in enumerate(PHRASED)], "k int, line string")
    got = {r["k"]: r for r in resolver_lines.lex(lines).collect()}
    for k, (line, verb, refs) in enumerate(PHRASED):
        assert (got[k]["verb"], got[k]["subject"], got[k]["object"], got[k]["third"]) == (verb, *refs), line


def test_every_phrase_is_reached_by_its_opening():
    for verb, _, phrase in resolver_lines.PHRASES:
        assert verb == "cant_be_satisfied" or all(w and not set(w) & set("?{\\(") for w in resolver_lines._openings(phrase)), phrase


def test_sections(spark):
    s = resolver_lines.trace_sections(resolver_lines.lex(one(spark, "apt", APT + "\n" + APT))).orderBy("section_idx").collect()
    assert [(r["broken_count"], r["is_primary"], r["completed"]) for r in s] == [(2, True, True), (0, False, True)]


def test_graph(spark):
    tokens = resolver_lines.lex(one(spark, "apt", APT))
    edges = conflicts.edges(tokens)
    held = edges.where("kind = 3").first()
    assert (held["src"], held["dst"], held["score_src"], held["score_dst"]) == ("libb:amd64", "liba:amd64", 4, 5)
    nodes = {r["pkg"]: r for r in conflicts.nodes(tokens).collect()}
    assert nodes["libb:amd64"]["mode"] == 6 and nodes["libb:amd64"]["cand_version"] == "3" and nodes["liba:amd64"]["bits"] & 1
    foreign = spark.createDataFrame([("r1", "libppa:amd64")], "run_key string, pkg string")
    blame = conflicts.blame_edges(edges, foreign)
    found = {r["pkg"]: r for r in conflicts.classify(conflicts.roots(blame), blame, conflicts.nodes(tokens), edges, foreign).collect()}
    assert found["libb:amd64"]["cause"] == "holdback_blocks_new_dep" and found["libb:amd64"]["cascade"] == ["liba:amd64", "libc:amd64"] and found["libb:amd64"]["fragile"]
    assert found["libppa:amd64"]["cause"] == "third_party_pin" and found["libppa:amd64"]["cascade"] == ["libd:amd64"]
    assert conflicts.report(conflicts.roots(blame), blame).first()["roots"] == 2


def plain_search(pairs):
    """Roots one after another, by looking at everything each time."""
    causes = sorted({a for a, _ in pairs})
    hit = lambda x: sum(b == x for _, b in pairs)
    out, covered = [], set()

    def reach(root):
        seen, queue = [root], [root]
        while queue:
            here = queue.pop(0)
            for b in sorted({b for a, b in pairs if a == here}):
                if b not in seen:
                    seen.append(b)
                    queue.append(b)
        return seen

    for root in [a for a in causes if not hit(a)]:
        out.append((root, reach(root)[1:], False))
        covered |= set(reach(root))
    while left := [a for a in causes if a not in covered]:
        made = lambda x: sum(a == x for a, _ in pairs)
        root = min(left, key=lambda x: (hit(x) - made(x), -made(x), x))
        out.append((root, reach(root)[1:], True))
        covered |= set(reach(root))
    return out


def test_cascades_by_brute_force():
    import random

    rng = random.Random(5)
    for n in range(300):
        names = "abcdefgh"[: rng.randint(2, 8)]
        pairs = sorted({(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(rng.randint(1, 14))) if a != b})
        assert conflicts.search(pairs) == plain_search(pairs), pairs


def test_search_breaks_cycles():
    assert conflicts.search([("a", "b"), ("b", "c")]) == [("a", ["b", "c"], False)]
    assert conflicts.search([("a", "b"), ("b", "a"), ("b", "c")]) == [("b", ["a", "c"], True)]
    assert conflicts.search([]) == []


def test_sightings():
    see = lambda **k: {"raw": "@", "cur_version": None, "cand_version": None, "selection": 0, "mode": 0, "status": "unknown", "bits": 0, "blame": False, "only_bits": False} | k
    held, new = see(mode=6, cand_version="3", selection=2, blame=True), see(mode=3, cand_version="3", selection=1, bits=2)
    assert conflicts.merge_sightings([new, held])["mode"] == 6 and conflicts.merge_sightings([held, new])["mode"] == 6
    assert conflicts.merge_sightings([held, new])["bits"] == 2


def test_livelock(spark):
    body = ["Log time: 2026-04-25 10:00:06"] + ["  Holding Back x rather than change y", "Upgrading: x due to z"] * 6 + ["Done"]
    o = ordered.oscillations(resolver_lines.lex(one(spark, "apt", "\n".join(body))), ["run_key"], "subject", "line_no", F.col("verb").isin(*resolver_lines.KEEPS), F.col("verb").isin(*resolver_lines.UPGRADES), "object").collect()
    assert [(r["subject"], r["reversals"], r["blocked_by"], r["forced_by"], r["is_terminal"]) for r in o] == [("x", 6, "y", "z", True)]


def test_terminal(spark):
    t = one(spark, "apt_term", TERM)
    f = {(r["package"] or r["archive"]): r for r in terminal.failures(t).collect()}
    assert f["python3"]["kind"] == "maintainer-script" and f["python3"]["blamed_package"] == "llvm-21-tools" and f["python3"]["exit_status"] == 4 and "SyntaxWarning" not in f["python3"]["reason"]
    assert f["idle"]["kind"] == "dependency" and f["idle"]["blamed_package"] == ""
    assert (f["/tmp/b.deb"]["kind"], f["/tmp/b.deb"]["conflicting_package"], f["/tmp/b.deb"]["conflicting_path"]) == ("file-conflict", "c", "/usr/bin/b")
    assert sorted(r["package"] for r in terminal.summary(t).collect()) == ["idle", "python3"]
    c = terminal.counters(t).where("start is not null").first()
    assert c["configured"] == 1 and not c["truncated"]


def test_history(spark):
    text = "\nStart-Date: 2026-06-23  11:13:22\nCommandline: x\nInstall: a:amd64 (1.0, automatic), b (2)\nUpgrade: c (1, 2)\nEnd-Date: 2026-06-23  11:14:22\n\nStart-Date: 2026-06-23  11:13:22\nInstall: a:amd64 (1.0, automatic), b (2)\nUpgrade: c (1, 2)\nEnd-Date: 2026-06-23  11:13:30"
    h = terminal.history(one(spark, "history", text))
    rows = h.orderBy("line_no").collect()
    assert len(rows) == 2 and [x["name"] for x in rows[0]["changes"]["Install"]] == ["a:amd64", "b"] and rows[0]["changes"]["Install"][0]["automatic"]
    assert rows[0]["changes"]["Upgrade"][0]["previous"] == "1" and rows[0]["changes"]["Upgrade"][0]["version"] == "2"
    assert [r["line_no"] for r in terminal.collapsed(h).collect()] == [rows[0]["line_no"]]


def test_diagnosis_end_to_end(spark):
    d = diagnosis.diagnose(lines(spark, main=MAIN, apt=APT))
    found = d.findings.orderBy("rank").collect()
    names = [r["rule"] for r in found]
    assert found[0]["cause"] == "holdback_blocks_new_dep" and "net.update-failed" not in names and "evidence.truncated" not in names
    assert "resolver.third-party-blocker" in names
    assert d.signatures.first()["root_graph"] and d.signatures.first()["cause_tuple"]
    rec = report.json_records(d.facts, d.findings).first()["record"]
    assert '"schema":1' in rec and "holdback_blocks_new_dep" in rec
    assert "libb" in report.markdown_reports(d.facts, d.findings).first()["report"]
    told = json.loads(report.triage_records(d).first()["record"])
    assert len(told) == 36 and told["cause"] == "holdback_blocks_new_dep" and told["severity"] == "high" and told["lex_unmatched"] == 1 and told["unknown_shapes"] == [{"template": "a line of no known phrase", "count": 1}]
    assert told["apt_broken_count"] == 2 and told["logs_present"] == ["apt", "main"] and told["rules_withheld"] == [] and told["evidence_complete"] and told["corroborated"] == ["holdback_blocks_new_dep", "third_party_pin"]
    page = report.run_pages(d).first()["report"]
    for head in ("# libb held back", "## Diagnosis", "## What the log says", "## Packages from elsewhere", "## Fragile decision", "## Run", "## Counts", "## Method"):
        assert head in page, head
    assert "## Livelock" not in page
    digest = report.corpus_digest(d, similarity.clusters(d.signatures))
    assert "1 run diagnosed" in digest and "| `holdback_blocks_new_dep` | 1 |" in digest and "## Alone: 1" in digest
    assert d.findings.orderBy("rank").select(rules.title().alias("t")).first()["t"] == "libb held back, blocking 2 packages"


def test_truncated_run_names_no_cause(spark):
    d = diagnosis.diagnose(lines(spark, main="2026-04-25 10:00:00,000 INFO Using config files\n2026-04-25 10:00:02,000 DEBUG running Quirks.PreDistUpgradeCache"))
    assert [r["rule"] for r in d.findings.collect()] == ["evidence.truncated"]


def test_message_rules(spark):
    rows = [("a", 1, "ERROR", "Not enough free space: 5 GB on /"), ("b", 1, "ERROR", "'x' was not downloadable"), ("b", 0, "ERROR", "noise"), ("c", 1, "ERROR", "An upgrade from 'noble' to 'zz' is not supported with this tool"), ("d", 1, "DEBUG", "Not running as root!")]
    rec = spark.createDataFrame(rows, "run_key string, seq int, level string, message string")
    facts = spark.createDataFrame([(k, True, False, 60, "CALCULATE", None, None, None, []) for k in "abcd"], "run_key string, evidence_complete boolean, reached_dpkg boolean, terminal_phase int, phase_name string, problem_type string, traceback string, duplicate_signature string, missing_logs array<string>")
    got = {r["run_key"]: (r["rule"], r["summary"]) for r in rules.message_rules(rules.Corpus(facts, rec)).collect()}
    assert got == {"a": ("env.disk-space", "not enough free disk space: 5 GB on /"), "b": ("net.download-failed", "the upgrade could not be downloaded"), "c": ("env.unsupported-path", "upgrading from noble to zz is not a supported path")}


def test_clusters_extend_and_drop(spark):
    rows = [("a", "g1", "c1"), ("b", "g1", "c1"), ("c", None, "c1"), ("d", "g2", "c2"), ("e", "g2", "c3"), ("f", "g3", "c3"), ("g", "g3", "c2"), ("h", None, "c4"), ("i", None, "c4"), ("j", None, None), ("k", None, "c2")]
    s = spark.createDataFrame(rows, "run_key string, root_graph string, cause_tuple string")
    got = {}
    for r in similarity.clusters(s).collect():
        got.setdefault(r["canonical"], set()).add((r["run_key"], r["joined_tier"]))
    assert got == {"a": {("a", 0), ("b", 0), ("c", 1)}, "d": {("d", 0), ("e", 0)}, "f": {("f", 0), ("g", 0)}, "h": {("h", 1), ("i", 1)}}
    assert [r["run_key"] for r in similarity.unresolved(s).collect()] == ["j"]
