"""Records for machines and people, from result tables.

JSON records and lines of a report are columns, so they are written by executors; only a
page that a person reads (a bounded top of a list) is put together on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.conflicts import broken_packages
from ..operators.resolver_lines import coverage, unknown_shapes_by_run
from ..operators.rules import NEEDS_ALL, POST_UPGRADE, PRIORITY, STRONG, primary, rules_digest, title
from ..operators.similarity import summarise
from .diagnosis import Diagnosis, metadata

#: Raised when a key of the record goes or changes its meaning.
SCHEMA = 1
SEVERITIES, CONFIDENCES = ("info", "low", "medium", "high"), ("weak", "moderate", "strong", "certain")
#: What a tracker tells of a run; nulls where none does.
TRACKER = {"bug_id": "long", "attempt": "int", "reported_at": "timestamp", "duplicate_of": "long", "duplicate_count": "int"}
TOOL_VERSION = "1"


def _word(words: tuple[str, ...], level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), level + 1)


def _per_run(d: Diagnosis, tracker: DataFrame | None) -> DataFrame:
    """One row a run with all that records and pages tell of it."""
    f = d.findings.withColumn("title", title())
    fields = [c for c in f.columns if c != "run_key"]
    ranked = f.groupBy("run_key").agg(F.sort_array(F.collect_list(F.struct("rank", "rule", "cause", "title", "summary", "severity", "confidence", "root_pkgs", "victim_pkgs", "cascade_size", "score_margin", "fragile", "corroborated", F.to_json("detail").alias("detail")))).alias("findings"))
    top = primary(d.findings.withColumn("title", title())).select("run_key", F.struct(*fields).alias("top"))
    lex = coverage(d.tokens).select("run_key", F.struct("lines", "unmatched", "coverage").alias("lex"))
    shapes = unknown_shapes_by_run(d.tokens)
    trace = d.sections.where("is_primary").select("run_key", F.col("broken_count").alias("apt_broken"), "passes")
    broken = broken_packages(d.nodes).groupBy("run_key").agg(F.count(F.lit(1)).alias("seen_broken"))
    graph = d.edges.groupBy("run_key").agg(F.count(F.lit(1)).alias("edges"))
    meta = metadata(d.records)
    out = d.facts
    for part in (ranked, top, lex, shapes, trace, broken, graph, meta, d.signatures.select("run_key", "root_graph", "cause_tuple")):
        out = out.join(part, "run_key", "left")
    if tracker is not None:
        return out.join(tracker.select("run_key", *[(F.col(c) if c in tracker.columns else F.lit(None)).cast(t).alias(c) for c, t in TRACKER.items()]), "run_key", "left")
    return out.withColumns({c: F.lit(None).cast(t) for c, t in TRACKER.items()})


def triage_records(d: Diagnosis, tracker: DataFrame | None = None) -> DataFrame:
    """(run_key, record): a run's triage as one JSON text of 36 keys."""
    rows = _per_run(d, tracker)
    none = F.array().cast("array<string>")
    found = F.coalesce("findings", F.array().cast(rows.schema["findings"].dataType))
    names = lambda keep: F.sort_array(F.array_distinct(F.transform(F.filter(found, keep), lambda x: x["cause"])))
    done = F.coalesce("reached_dpkg", F.lit(False)) & (F.col("terminal_phase") >= POST_UPGRADE)
    withheld = F.when(F.col("evidence_complete"), none).otherwise(F.array(*[F.lit(r) for r in sorted(k for k, v in NEEDS_ALL.items() if v)]))
    sure = F.coalesce(F.col("top.confidence") >= STRONG, F.lit(False))
    caveats = F.transform(F.filter(found, lambda x: x["cause"] == "no_failure_recorded"), lambda x: x["summary"])
    values = {
        "schema": F.lit(SCHEMA), "key": F.col("run_key"), "bug_id": F.col("bug_id"), "attempt": F.coalesce("attempt", F.lit(0)), "from_series": F.col("from_series"), "to_series": F.col("to_series"),
        "title": F.col("top.title"), "title_confident": sure, "cause": F.col("top.cause"), "severity": _word(SEVERITIES, F.col("top.severity")), "confidence": _word(CONFIDENCES, F.col("top.confidence")),
        "root_packages": F.coalesce("top.root_pkgs", none), "cascade_size": F.coalesce("top.cascade_size", F.lit(0)), "fragile": F.coalesce("top.fragile", F.lit(False)), "candidate_invalid": F.coalesce(F.col("top.cause") == "third_party_pin", F.lit(False)),
        "corroborated": names(lambda x: x["corroborated"]), "terminal_phase": F.col("phase_name"), "evidence_complete": F.col("evidence_complete"), "dpkg_wrote": F.col("reached_dpkg"), "upgrade_completed": done,
        "logs_present": F.col("logs_present"), "apt_broken_count": F.coalesce("apt_broken", F.lit(0)), "observed_broken_count": F.coalesce("seen_broken", F.lit(0)),
        "rules_fired": F.sort_array(F.array_distinct(F.transform(found, lambda x: x["rule"]))), "rules_withheld": withheld, "notes": caveats,
        "lex_lines": F.coalesce("lex.lines", F.lit(0)), "lex_unmatched": F.coalesce("lex.unmatched", F.lit(0)), "lex_coverage": F.coalesce("lex.coverage", F.lit(1.0)), "unknown_shapes": F.coalesce("unknown_shapes", F.array().cast(rows.schema["unknown_shapes"].dataType)),
        "tool_version": F.lit(TOOL_VERSION), "rules_digest": F.lit(rules_digest()), "reported_at": F.col("reported_at"), "duplicate_of": F.col("duplicate_of"), "duplicate_count": F.coalesce("duplicate_count", F.lit(0)), "signature": F.struct("root_graph", "cause_tuple"),
    }
    return rows.select("run_key", F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"}).alias("record"))


def run_pages(d: Diagnosis, tracker: DataFrame | None = None) -> DataFrame:
    """(run_key, report): a Markdown page a run; a section that has nothing to say is left out."""
    rows = _per_run(d, tracker)
    found = F.coalesce("findings", F.array().cast(rows.schema["findings"].dataType))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("not known"))
    section = lambda head, body: F.when(F.length(body) > 0, F.concat(F.lit(f"## {head}\n\n"), body))
    listed = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    of = lambda rule: F.filter(found, lambda x: x["rule"] == rule)
    summaries = lambda items: F.transform(items, lambda x: x["summary"])
    packages = lambda x: F.array_join(F.transform(x["root_pkgs"], code), ", ")
    own = F.filter(found, lambda x: (x["cause"] != "no_failure_recorded") & (x["rule"] != "resolver.fragile-decision"))
    diagnosis = listed(F.transform(own, lambda x: F.concat(F.lit("**"), x["title"], F.lit("**: "), x["summary"], F.when(F.size(x["root_pkgs"]) > 0, F.concat(F.lit(" ("), packages(x), F.lit(")"))).otherwise(""))))
    errors = d.records.where("level = 'ERROR'").groupBy("run_key").agg(F.slice(F.sort_array(F.collect_set(F.struct("seq", "message"))), 1, 20).alias("x")).select("run_key", F.transform("x", lambda e: code(e["message"])).alias("errors"))
    rows = rows.join(errors, "run_key", "left")
    pairs = (("from", "from_series"), ("to", "to_series"), ("last phase", "phase_name"), ("evidence complete", "evidence_complete"), ("packages were written", "reached_dpkg"), ("upgrader", "upgrader_version"), ("apt", "apt_version"), ("kernel", "kernel"), ("locale", "locale"))
    facts = F.concat_ws("\n", *[F.concat(F.lit(f"- {k}: "), said(c)) for k, c in pairs], F.concat(F.lit("- logs: "), F.array_join("logs_present", ", ")))
    counts = F.concat_ws("\n", *[F.concat(F.lit(f"| {k} | "), F.coalesce(F.col(c).cast("string"), F.lit("0")), F.lit(" |")) for k, c in (("broken, as apt counts", "apt_broken"), ("packages seen broken", "seen_broken"), ("edges of the graph", "edges"), ("lines of the trace", "lex.lines"), ("lines not understood", "lex.unmatched"))])
    caveats = F.array_compact(F.concat(summaries(F.filter(found, lambda x: x["cause"] == "no_failure_recorded")), F.array(F.when(~F.col("evidence_complete"), F.lit("rules that need complete evidence were not applied")))))
    close = F.transform(of("resolver.fragile-decision"), lambda x: F.concat(x["summary"], F.lit(": "), packages(x)))
    page = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), F.coalesce("top.title", F.col("run_key"))), F.concat(F.lit("Run "), code(F.col("run_key"))),
        F.lit("## Diagnosis"), F.when(F.length(diagnosis) > 0, diagnosis).otherwise("No rule matched."),
        section("What the log says", listed(F.coalesce("errors", F.array().cast("array<string>")))),
        section("Livelock", listed(summaries(of("resolver.livelock")))),
        section("Packages from elsewhere", listed(summaries(of("resolver.third-party-blocker")))),
        section("Fragile decision", listed(close)),
        section("Run", facts), section("Counts", F.concat(F.lit("| what | n |\n| --- | --- |\n"), counts)),
        section("Caveats", listed(caveats)),
        F.lit("## Method\n\nRules over the run's logs alone; what its report says in prose, its title and tags are not read."),
        F.concat(F.lit("Rules that fired: "), F.coalesce(F.nullif(F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda x: code(x["rule"])))), ", "), F.lit("")), F.lit("none")), F.lit(f", of {len(PRIORITY)}.")),
    )
    return rows.select("run_key", page.alias("report"))


def corpus_digest(d: Diagnosis, members: DataFrame, most: int = 50) -> str:
    """A page on a corpus: causes, classes (the ``most`` largest), and what is alone, invalid, unread or incomplete; ``most`` of each list reach the driver."""
    top = primary(d.findings).withColumn("title", title()).select("run_key", "cause", "title", "confidence")
    runs = d.facts.select("run_key", "evidence_complete", "logs_present").join(top, "run_key", "left").join(members.select("run_key", "cluster", "tier", "member_count", "canonical"), "run_key", "left")
    n, sizes = runs.count(), summarise(members).first()
    out = ["# Digest of upgrade failures", f"{plural(n, 'run')} diagnosed; {plural(sizes['clusters'], 'class', 'classes')} with {plural(sizes['duplicates'], 'likely duplicate')}, the largest of {sizes['largest']}."]
    causes = runs.groupBy(F.coalesce("cause", F.lit("unknown")).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").collect()  # at most as many as causes
    out += ["## By cause", "\n".join(["| cause | runs |", "| --- | --- |", *[f"| `{r['c']}` | {r['n']} |" for r in causes]])]
    heads = runs.where("run_key = canonical").orderBy(F.desc("member_count"), "tier", "run_key")
    shown = heads.limit(most).collect()
    out += ["## Classes", "\n".join(f"- {r['title'] or r['run_key']}: {plural(r['member_count'], 'run')} by tier {r['tier']}, master {r['run_key']}" for r in shown)] if shown else []
    parts = (
        ("Alone", runs.where("cluster is null"), lambda r: r["title"] or "no cause"),
        ("Candidates for Invalid", runs.where("cause = 'third_party_pin'"), lambda r: r["title"]),
        ("To be read by a person", runs.where(f"cause is null or cause = 'unknown' or confidence < {STRONG}"), lambda r: "no rule matched" if r["cause"] is None else "low confidence"),
        ("Incomplete evidence", runs.where("not evidence_complete"), lambda r: ", ".join(r["logs_present"] or []) or "nothing usable"),
    )
    for head, rows, tell in parts:
        total, first = rows.count(), rows.orderBy("run_key").limit(most).collect()
        if total:
            more = [f"- and {total - most} more"] if total > most else []
            out += [f"## {head}: {total}", "\n".join([*[f"- {r['run_key']}: {tell(r)}" for r in first], *more])]
    return "\n\n".join(out) + "\n"


def json_records(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_key, record): one JSON text a run with its ranked findings."""
    f = findings.withColumn("title", title())
    keep = [c for c in ("rank", "rule", "cause", "title", "summary", "severity", "confidence", "root_pkgs", "victim_pkgs", "cascade_size", "score_margin", "fragile", "detail") if c in f.columns]
    listed = f.groupBy("run_key").agg(F.array_sort(F.collect_list(F.struct(*keep[:-1]))).alias("findings"), F.count(F.lit(1)).alias("n"))
    j = runs.join(listed, "run_key", "left")
    return j.select("run_key", F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), *[F.col(c) for c in runs.columns], F.coalesce("findings", F.array()).alias("findings"))).alias("record"))


def code(text: Column) -> Column:
    return F.concat(F.lit("`"), F.regexp_replace(text, "`", "'"), F.lit("`"))


def finding_lines(findings: DataFrame) -> DataFrame:
    """(run_key, rank, line): a Markdown line for each finding."""
    n = F.col("cascade_size")
    roots = F.array_join(F.transform("root_pkgs", lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")
    line = F.concat(F.lit("- **"), title(), F.lit("**: "), F.col("summary"), F.when(F.size("root_pkgs") > 0, F.concat(F.lit(" (roots: "), roots, F.lit(")"))).otherwise(""), F.when(n > 0, F.concat(F.lit(", "), n.cast("string"), F.lit(" affected"))).otherwise(""))
    return findings.select("run_key", "rank", line.alias("line"))


def markdown_reports(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_key, report): one Markdown text a run."""
    lines = finding_lines(findings).groupBy("run_key").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    facts = F.concat_ws("\n", *[F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in runs.columns if c != "run_key"])
    return runs.join(lines, "run_key", "left").select("run_key", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("run_key")), facts, F.lit("## Findings"), F.coalesce(body, F.lit("No rule matched."))).alias("report"))


def plural(n: int, singular: str, irregular: str = "") -> str:
    return f"{n} {singular if n == 1 else irregular or singular + 's'}"


def elide(text: str, limit: int) -> str:
    text = " ".join(text.split())
    return text if len(text) <= limit else text[: limit - 1].rstrip() + "…"


def worklist_page(items: DataFrame, rows_per_bucket: int = 20) -> str:
    """A page of the first rows of each bucket; at most ``rows_per_bucket`` a bucket reach the driver."""
    from ..operators.corpus import rank_capped
    from ..operators.worklist import BUCKETS

    counts = {r["bucket"]: r["n"] for r in items.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = rank_capped(items, ["bucket"], [F.asc("run_key")], rows_per_bucket, F.lit(False)).select("bucket", "rank", "run_key", "title").collect()
    out = ["# Worklist"]
    for b in BUCKETS:
        out.append(f"## {b}: {plural(counts.get(b, 0), 'run')}")
        out += [f"- {r['run_key']}: {elide(r['title'] or '', 100)}" for r in sorted((r for r in top if r["bucket"] == b), key=lambda r: r["rank"])]
    return "\n".join(out)
