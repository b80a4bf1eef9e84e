"""Commands over a store of runs: ``python -m lodestone.cli COMMAND ...``.

diagnose, title, ingest, fetch, dedup, related, history, coverage, show, rules, stats, sweep,
refresh, queue, todo, clean.  Results print as tables, or as JSON lines with ``--json``.
Exit codes: 0 done, 1 failed, 2 wrong usage, 3 (``--strict``) something is undiagnosed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus, resolver_lines, rules, similarity, worklist
from .operators import state as merges
from .plans import diagnosis, report
from .sources import bugs, config, logs
from .sources.store import Store
from .streaming import incremental


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def show(df: DataFrame, as_json: bool, limit: int | None = None) -> None:
    """Every row as a JSON line, read from Spark partition by partition; a table for people ends after ``limit`` (50) rows and says so."""
    if as_json:
        for row in (df if limit is None else df.limit(limit)).toJSON().toLocalIterator():
            print(row)
        return
    most = limit or 50
    df.show(most, truncate=100)
    if len(df.take(most + 1)) > most:
        print(f"... only the first {most} rows are shown; --json prints all")


def diagnosed(spark: SparkSession, folder: str, settings: config.Config) -> tuple[DataFrame, diagnosis.Diagnosis]:
    found = logs.attempts(logs.files(spark, folder))
    options = {"limit": settings.rules.max_findings, "disabled": list(settings.rules.disabled)}
    if settings.rules.enabled is not None:
        options["enabled"] = list(settings.rules.enabled)
    return found, diagnosis.diagnose(logs.lines(found), **options)


def run_rows(found: DataFrame, d: diagnosis.Diagnosis, settings: config.Config) -> DataFrame:
    """Rows of the store's ``runs`` from a diagnosis."""
    keys = found.groupBy("run_key").agg(F.first("attempt").alias("attempt"), F.max("is_primary").alias("is_primary"), F.first("folder").alias("source_dir"))
    top = rules.primary(d.findings).withColumn("current_title", rules.title(settings.title.max_length)).select("run_key", F.col("cause").alias("top_cause"), "cascade_size", "fragile", (F.col("cause") == "third_party_pin").alias("third_party"), "current_title")
    lex = resolver_lines.coverage(d.tokens).select("run_key", F.col("lines").alias("lex_lines"), F.col("unmatched").alias("lex_unmatched"))
    meta = diagnosis.metadata(d.records).select("run_key", "from_series", "to_series")
    out = keys
    for part in (d.facts.select("run_key", "problem_type", "terminal_phase", "evidence_complete", "reached_dpkg"), top, lex, meta, d.signatures.select("run_key", "root_graph", "cause_tuple")):
        out = out.join(part, "run_key", "left")
    number = F.regexp_extract("source_dir", r"(\d{5,})/?$", 1).try_cast("long")
    return out.withColumns({"bug_id": number, "arch": F.lit(None).cast("string"), "ingested_at": F.current_timestamp(), "tool_version": F.lit("1"), "rules_digest": F.lit(rules.rules_digest())})


def members(store: Store, settings: config.Config) -> DataFrame:
    primary = store.table("runs").where("is_primary").select("run_key", "root_graph", "cause_tuple")
    return similarity.clusters(primary, most=settings.dedup.max_cluster_size)


def items(store: Store, settings: config.Config) -> DataFrame:
    runs = store.table("runs").where("is_primary").select("run_key", "bug_id", "top_cause", "evidence_complete", "third_party", "current_title")
    states = store.table("bug_state")
    return worklist.classify(worklist.triage_rows(runs, states), members(store, settings), corpus.duplicate_roots(states.select("bug_id", "duplicate_of")))


def command(a: argparse.Namespace) -> int:
    settings = config.load(config.find(__import__("pathlib").Path.cwd()) if a.config is None else __import__("pathlib").Path(a.config))
    spark = session()
    if a.command == "rules":
        for name, p in sorted(rules.PRIORITY.items(), key=lambda x: (x[1], x[0])):
            print(p, name, "needs complete evidence" if rules.NEEDS_ALL[name] else "")
        return 0
    if a.command in ("diagnose", "title"):
        found, d = diagnosed(spark, a.target, settings)
        if a.command == "title":
            show(rules.primary(d.findings).select("run_key", rules.title(settings.title.max_length).alias("title")), a.json)
        elif a.markdown:
            for row in report.run_pages(d).toLocalIterator():
                print(row["report"])
        else:
            if a.json:
                for row in report.triage_records(d).toLocalIterator():
                    print(row["record"])
            else:
                show(d.findings.orderBy("run_key", "rank"), False)
        open_ = d.facts.join(rules.primary(d.findings).where("cause not in ('unknown')").select("run_key"), "run_key", "left_anti")
        return 3 if a.strict and open_.head(1) else 0
    store = Store(spark, a.store)
    if a.command == "ingest":
        found, d = diagnosed(spark, a.target, settings)
        said = d.records.select("message").distinct()  # each message is masked once
        masked = said.select("message", diagnosis.T.mask(F.col("message"))["template"].alias("template"))
        templates = d.records.select("run_key", "message").join(masked, "message").select("run_key", "template")
        top = d.findings.select("run_key", F.explode("root_pkgs").alias("pkg"), F.lit("root").alias("role")).unionByName(d.findings.select("run_key", F.explode("victim_pkgs").alias("pkg"), F.lit("victim").alias("role")))
        store.put_runs(run_rows(found, d, settings), templates, top)
        show(store.table("runs").select("run_key", "top_cause", "current_title"), a.json)
    elif a.command == "dedup":
        store.replace_clusters(members(store, settings))
        show(store.table("clusters").orderBy(F.desc("member_count"), "tier", "canonical", "run_key"), a.json)
        drift = similarity.policy_drift(store.table("clusters"), store.table("runs").select("run_key", "tool_version", "rules_digest"))
        if drift.head(1):
            print("some classes hold runs diagnosed under different rules", file=sys.stderr)
    elif a.command == "related":
        runs = store.table("runs").where("is_primary").select("run_key", "root_graph", "cause_tuple")
        roots = store.table("run_packages").where("role = 'root'")
        asked = spark.createDataFrame([(a.target,)], "run_key string")
        show(corpus.related(runs, corpus.sharing(roots, "run_key", "pkg", settings.dedup.min_shared_roots, asked), queries=asked), a.json)
    elif a.command == "history":
        packages = store.table("run_packages")
        show(corpus.runs_with_package(packages, corpus.packages_matching(packages.select("pkg").distinct(), a.target)), a.json)
    elif a.command == "coverage":
        show(corpus.coverage_totals(store.table("runs")), a.json)
        show(corpus.imperfect(store.table("runs")), a.json, settings.tracker.max_rows)
    elif a.command == "show":
        show(store.table("runs").where(F.col("run_key") == a.target), a.json)
    elif a.command == "stats":
        show(corpus.histogram(store.table("runs"), F.coalesce("top_cause", F.lit("not_diagnosed")), "cause", F.col("is_primary")).orderBy(F.desc("n"), "cause"), a.json)
        show(corpus.top_counts(store.table("run_packages").where("role = 'root'"), ["pkg"], settings.report.top_packages, "run_key"), a.json)
    elif a.command == "fetch":
        spark.dataSource.register(bugs.TrackerSource)
        # complete=false in what is stored tells that the listing was cut off
        tasks = spark.read.format("bug_tracker").options(url=settings.tracker.url, interval=settings.tracker.interval, pages=settings.tracker.max_pages).load()
        tasks.write.mode("append").json(a.target)
    elif a.command == "sweep":
        tasks = bugs.read_tasks(spark, a.target)
        fresh = incremental.unseen(tasks.where("bug_id is not null"), store.known_bugs(), "bug_id", "created", a.limit).cache()
        show(fresh, a.json)
        if not a.dry_run:
            good, bad = fresh.where("created is not null"), fresh.where("created is null")
            store.put_states(good.withColumns({"is_duplicate": F.col("duplicate_of").isNotNull(), "checked_at": F.current_timestamp()}), ["modified", "bug_id"])
            # the cursor moves over what the store now has, and is held at the oldest that failed
            stored = good.join(store.table("bug_state").select("bug_id"), "bug_id", "left_semi")
            failed = good.join(store.table("bug_state").select("bug_id"), "bug_id", "left_anti")
            top = incremental.next_cursor(stored.select(F.col("created").cast("string").alias("created")), failed.select(F.col("created").cast("string").alias("created")), "created", None)
            if top:
                store.advance("sweep_watermark", top)
            if bad.head(1):
                print("tasks without a date were not stored", file=sys.stderr)
    elif a.command == "refresh":
        tasks = bugs.read_tasks(spark, a.target)
        now = tasks.select("bug_id", "status", "importance", "assignee", "title")
        whole = not a.partial and not tasks.where("not complete").head(1)
        changed, touched = incremental.refresh(store.table("bug_state").select("bug_id", "status", "importance", "assignee", "title"), now, whole, "bug_id", None, ["status", "importance", "assignee", "title"])
        show(changed, a.json)
        if not a.dry_run:
            store.touch_states(touched, F.current_timestamp())
            store.put_states(tasks.withColumns({"is_duplicate": F.col("duplicate_of").isNotNull(), "checked_at": F.current_timestamp()}), ["modified", "bug_id"])
    elif a.command == "queue":
        if a.markdown:
            print(report.worklist_page(items(store, settings), settings.tracker.max_rows))
        else:
            show(worklist.tallies(items(store, settings)), a.json)
            show(worklist.stale(items(store, settings), F.current_timestamp(), settings.tracker.stale_days), a.json)
    elif a.command == "todo":
        show(worklist.todo(items(store, settings), a.target or "").select("part", "importance_rank", "bug_id", "run_key", "status", "title"), a.json)
    elif a.command == "clean":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.target).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
        plan = merges.cache_plan(store.table("attachments").select("name", "size"), files, a.everything)
        show(merges.cache_totals(plan), a.json)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--store", default="store")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("diagnose", "title", "ingest", "fetch", "dedup", "related", "history", "coverage", "show", "rules", "stats", "sweep", "refresh", "queue", "todo", "clean"):
        c = sub.add_parser(name)
        c.add_argument("target", nargs="?" if name in ("dedup", "coverage", "rules", "stats", "queue", "todo") else None)
        for flag in ("--markdown", "--strict", "--dry-run", "--partial", "--everything"):
            c.add_argument(flag, action="store_true")
        c.add_argument("--limit", type=int, default=100)
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        return command(parser().parse_args(argv))
    except (ValueError, OSError) as e:
        print(f"lodestone: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
