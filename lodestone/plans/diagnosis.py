"""From cleaned log lines to ranked findings, for many runs in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conflicts, ordered, resolver_lines, rules, similarity, terminal
from ..sources.scratch import materialize as keep

FOREIGN = r"^Foreign \(before rewriting sources\):\s*(.*)$"
STACKS = (r"^Dist-upgrade failed:\s*(.*)$", r"^Can't mark '[^']*' for upgrade \((.*)\)$", r"^failed to mark '[^']*' for install \((.*)\)$", r"^openCache\(\) failed:\s*(.*)$", r"^(?:IOError|SystemError)[^:]*:\s*(.*)$")
LISTS = {"kept": r"^Keep at same version:\s*(.*)$", "held_back": r"^Upgradable, but held-\s*back:\s*(.*)$", "upgraded": r"^Upgrade:\s*(.*)$", "installed": r"^Install:\s*(.*)$", "removed": r"^Remove:\s*(.*)$", "obsolete": r"^Obsolete:\s*(.*)$", "meta": r"^MetaPkgs:\s*(.*)$", "foreign": FOREIGN}
META = {"apt_version": r"^apt version: '([^']*)'", "upgrader_version": r"^release-upgrader version '([^']*)' started", "view": r"^Using '([^']*)' view", "kernel": r"^uname information: 'Linux \S+ (\S+)", "locale": r"^locale: '([^']*)'", "from_series": r"^Upgrading from (\w+) to \w+", "to_series": r"^Upgrading from \w+ to (\w+)"}


def package_lists(records: DataFrame) -> DataFrame:
    """(run_key, list, pkg): the last list of each kind in the main log."""
    kinds = F.array(*[F.when(F.col("message").rlike(p), F.struct(F.lit(k).alias("list"), F.regexp_extract("message", p, 1).alias("body"))) for k, p in LISTS.items()])
    hits = records.select("run_key", "seq", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).groupBy("run_key", "x.list").agg(F.max_by("x.body", "seq").alias("body"))
    name = F.regexp_extract("token", r"^([A-Za-z0-9][A-Za-z0-9+._-]*(?::\w+)?)", 1)
    return hits.select("run_key", "list", F.explode(F.split("body", r"\s+")).alias("token")).select("run_key", "list", name.alias("pkg")).where("pkg <> ''").distinct()


def metadata(records: DataFrame) -> DataFrame:
    """One row a run: the first thing said under each key."""
    return records.groupBy("run_key").agg(*[F.min_by(F.regexp_extract("message", p, 1), F.when(F.col("message").rlike(p), F.col("seq"))).alias(k) for k, p in META.items()])


def error_stacks(records: DataFrame) -> DataFrame:
    """(run_key, seq, level, text) of the package manager's messages inside the program's errors."""
    whole = F.concat_ws("\n", "message", F.array_join("continuation", "\n"))
    stack = F.coalesce(*[F.when(F.col("w").rlike("(?s)" + p), F.regexp_extract("w", "(?s)" + p, 1)) for p in STACKS])
    rows = records.where("level in ('ERROR', 'WARNING')").withColumn("w", F.regexp_replace(whole, r"\n+$", "")).withColumn("s", stack).where("s is not null")
    return rows.select("run_key", "seq", F.explode(T.apt_messages(F.col("s"))).alias("m")).select("run_key", "seq", "m.level", "m.text")


@dataclass
class Diagnosis:
    facts: DataFrame
    records: DataFrame
    tokens: DataFrame
    sections: DataFrame
    edges: DataFrame
    nodes: DataFrame
    roots: DataFrame
    findings: DataFrame
    signatures: DataFrame


def diagnose(lines: DataFrame, reports: DataFrame | None = None, **options) -> Diagnosis:
    """``lines``: run_key, source, line_no, line.  ``reports``: run_key, problem_type, traceback, duplicate_signature.

    The graph is built of each run's primary section alone.  Tables that several later steps read
    (records, tokens, edges, ...) are written to the shared scratch folder once, so that no step parses
    the logs again and every plan stays small.
    """
    of = lambda s: lines.where(F.col("source") == s).drop("source")
    records = keep(ordered.running_phase(ordered.fold_records(of("main")), ordered.phase_of(F.col("message")), ["run_key"], ["seq"]))
    lexed = keep(resolver_lines.lex(of("apt")))
    secs = keep(resolver_lines.trace_sections(lexed))
    numbered = ordered.group_number(lexed, F.col("verb") == "log_time", ["run_key"], ["line_no"], "_sec")
    tokens = keep(numbered.join(secs.where("is_primary").select("run_key", "_sec"), ["run_key", "_sec"], "left_semi"))
    edge_rows, node_rows = keep(conflicts.edges(tokens)), keep(conflicts.nodes(tokens))
    lists = package_lists(records)
    seen = node_rows.select("run_key", "pkg")
    bare = lists.where("list = 'foreign'").select("run_key", F.col("pkg").alias("name"))
    known = seen.select("run_key", "pkg", T.package_name(F.col("pkg")).alias("name"))
    foreign = keep(bare.join(known, ["run_key", "name"], "left").select("run_key", F.coalesce("pkg", "name").alias("pkg")).distinct())
    blame = keep(conflicts.blame_edges(edge_rows, foreign))
    found = keep(conflicts.roots(blame))

    term_lines = of("apt_term")
    fails, summary, blocks = (keep(f(term_lines)) for f in (terminal.failures, terminal.summary, terminal.counters))
    stacks = keep(error_stacks(records))
    apt_errors = stacks.where("level = 'error'").select("run_key", "text")
    keys = lines.select("run_key").distinct()
    by = lambda df, *aggs: df.groupBy("run_key").agg(*aggs)
    own = by(records, F.max("phase").alias("terminal_phase"), F.count(F.lit(1)).alias("records"), F.max(F.col("message").startswith("abort called")).alias("aborted"), F.max((F.col("level") == "ERROR") & rules.is_terminal_error(F.col("message"))).alias("failed"))
    flags = keys.join(own, "run_key", "left").join(by(apt_errors, F.lit(True).alias("apt_failed")), "run_key", "left").join(by(secs, F.max("truncated").alias("apt_cut")), "run_key", "left")
    flags = flags.join(by(blocks, F.max("truncated").alias("term_cut"), F.max("line_count").alias("term_lines")), "run_key", "left").join(by(fails.where("kind <> 'dependency'"), F.lit(True).alias("dpkg_failed")), "run_key", "left")
    flags = flags.join(by(lines, F.array_except(F.array(F.lit("main"), F.lit("apt")), F.collect_set("source")).alias("missing_logs"), F.sort_array(F.collect_set("source")).alias("logs_present")), "run_key", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    phase = F.coalesce("terminal_phase", F.lit(0))
    complete = F.when(yes("apt_cut") | yes("term_cut"), False).when(yes("dpkg_failed"), True).when(F.coalesce("records", F.lit(0)) == 0, False).when(phase == ordered.PHASES["SCREEN_REEXEC"], False).otherwise(yes("aborted") | yes("apt_failed") | yes("failed") | (phase >= ordered.PHASES["POST_CLEANUP"]))
    wrote = F.when(F.col("term_lines").isNotNull(), F.col("term_lines") > 0).when(phase >= ordered.PHASES["COMMIT"], True).when(F.coalesce("records", F.lit(0)) > 0, False)
    names = F.create_map(*[F.lit(x) for k, v in ordered.PHASES.items() for x in (v, k)])
    facts = flags.select("run_key", complete.alias("evidence_complete"), wrote.alias("reached_dpkg"), phase.alias("terminal_phase"), names[phase].alias("phase_name"), "missing_logs", "logs_present")
    more = ("problem_type", "traceback", "duplicate_signature")
    facts = facts.join(reports.select("run_key", *more), "run_key", "left") if reports is not None else facts.withColumns({c: F.lit(None).cast("string") for c in more})

    facts = keep(facts)
    classified = keep(conflicts.classify(found.join(facts.select("run_key", F.col("evidence_complete").alias("_all")), "run_key", "left"), blame, node_rows, edge_rows, foreign, evidence_complete=F.coalesce("_all", F.lit(False))))
    # livelocks are looked for in the primary section, as the graph is
    osc = ordered.oscillations(tokens.withColumns({"subject": T.package_key(F.col("subject")), "object": T.package_key(F.col("object"))}), ["run_key"], "subject", "line_no", F.col("verb").isin(*resolver_lines.KEEPS), F.col("verb").isin(*resolver_lines.UPGRADES), "object")
    findings = keep(rules.diagnose(rules.Corpus(facts, records, apt_errors, fails, summary, classified, keep(osc), foreign), **options))
    top = rules.primary(findings)
    members = top.select("run_key", F.explode(F.array_union("root_pkgs", F.when(F.col("from_graph"), F.col("victim_pkgs")).otherwise(F.array().cast("array<string>")))).alias("pkg"))
    graph = conflicts.canonical_digest(members.join(top.where("from_graph").select("run_key"), "run_key", "left_semi"), blame)
    causes = top.join(facts.select("run_key", "terminal_phase"), "run_key").select("run_key", F.when(F.size("root_pkgs") > 0, similarity.cause_digest(F.col("cause"), F.transform("root_pkgs", T.package_label), F.col("terminal_phase"))).alias("cause_tuple"), "cause")
    signatures = keys.join(graph.withColumnRenamed("digest", "root_graph"), "run_key", "left").join(causes, "run_key", "left")
    return Diagnosis(facts, records, lexed, secs, edge_rows, node_rows, classified, findings, signatures)
