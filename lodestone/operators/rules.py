"""Diagnosis rules over runs, and the ranking of what they find.

All rules that read messages and facts share one scan: each of their predicates is a column, one aggregation
a run gives the first hits with their details, and the run's findings are an array built of these.  A rule over another
table (package failures, conflict roots, livelocks) is a function from a ``Corpus`` (the parsed tables of many runs) to findings,
which join the array.  Arrays are cleared of repeats, ordered, cut and exploded once; a run's findings are bounded by its
logs, whose sizes have caps.  Message rules are written as the program's own message texts with ``%s`` blanks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

INFO, LOW, MEDIUM, HIGH = 0, 1, 2, 3
WEAK, MODERATE, STRONG, CERTAIN = 0, 1, 2, 3
COMMIT, POST_UPGRADE = 70, 75

FINDING = "run_key string, rule string, cause string, summary string, severity int, confidence int, root_pkgs array<string>, victim_pkgs array<string>, cascade_size int, from_graph boolean, score_margin int, fragile boolean, detail map<string,string>"
COLUMNS = [c.split()[0] for c in FINDING.split(", ")]

#: Rule, cause, severity, priority, summary, messages with the names of their blanks.
MESSAGE_RULES = (
    ("env.disk-space", "not_enough_disk_space", HIGH, 10, "not enough free disk space: {required}", (("Not enough free space: %s", "required"),)),
    ("env.not-root", "filesystem_not_writable", HIGH, 11, "the upgrader was not run as root", (("Not running as root!",),)),
    ("env.not-writable", "filesystem_not_writable", HIGH, 12, "a required path is not writable: {path}", (("%s not writable", "path"), ("Can not write to '%s'", "path"), ("error '%s' when trying to write to the conffile", "error"))),
    ("env.cache-locked", "cache_lock_failed", HIGH, 13, "another package manager holds the apt lock: {error}", (("Cache can not be locked (%s)", "error"),)),
    ("env.ssh-blocked", "ssh_upgrade_blocked", MEDIUM, 14, "the upgrade was refused because it was started over SSH", (("upgrade over ssh not allowed",), ("Upgrading over remote connection not supported",))),
    ("env.esp-unusable", "esp_unusable", HIGH, 15, "the EFI system partition is not usable", (("EFI System Partition (ESP) not usable",),)),
    ("env.unsupported-path", "unsupported_upgrade_path", HIGH, 16, "upgrading from {source} to {target} is not a supported path", (("An upgrade from '%s' to '%s' is not supported", "source", "target"),)),
    ("env.lxd-installed", "unsupported_upgrade_path", MEDIUM, 17, "lxd is installed, which the upgrader refuses to upgrade through", (("lxd is installed",),)),
    ("net.auth-failed", "package_auth_failed", HIGH, 20, "packages could not be authenticated: {packages}", (("Unauthenticated packages found: '%s'", "packages"),)),
    ("net.download-failed", "download_failed", HIGH, 21, "the upgrade could not be downloaded", (("giving up on fetching after maximum retries",), ("'%s' was not downloadable", "item"), ("No '%s' available/downloadable after sources.list rewrite+update", "item"))),
    ("upgrader.view-depends", "view_depends_missing", HIGH, 30, "the upgrader's own frontend dependencies are not satisfied", (("checkViewDepends() failed",), ("depends '%s' is not satisfied", "dependency"), ("No view can be imported, aborting",))),
    ("upgrader.python-symlink", "python_symlink_broken", HIGH, 31, "/usr/bin/python3 does not point where the upgrader expects", (("pythonSymlinkCheck() failed, aborting",),)),
    ("upgrader.downgrade", "unsupported_upgrade_path", HIGH, 32, "the upgrade would downgrade packages: {packages}", (("Packages to downgrade found: '%s'", "packages"),)),
    ("upgrader.post-install-script", "post_install_script_error", MEDIUM, 33, "a post-install script failed: {script}", (("got error from PostInstallScript %s (%s)", "script", "error"),)),
    ("upgrader.broken-after-upgrade", "broken_packages_after_upgrade", HIGH, 34, "packages were left broken after the upgrade finished: {packages}", (("Broken packages after upgrade: %s", "packages"),)),
)
#: The other rules' priority, severity, confidence, and whether they need complete evidence.
OTHER_RULES = {
    "dpkg.interrupted": (5, HIGH, CERTAIN, True), "upgrader.crash": (6, HIGH, CERTAIN, True), "net.update-failed": (22, HIGH, STRONG, True), "upgrader.metapkg-install-failed": (35, HIGH, STRONG, True),
    "dpkg.failures": (40, HIGH, STRONG, True), "resolver.livelock": (50, HIGH, STRONG, False), "resolver.roots": (100, MEDIUM, STRONG, False), "resolver.third-party-blocker": (100, HIGH, STRONG, False),
    "resolver.fragile-decision": (200, INFO, STRONG, False), "evidence.truncated": (900, INFO, CERTAIN, False), "upgrader.no-failure": (901, INFO, STRONG, True),
}
PRIORITY = {r[0]: r[3] for r in MESSAGE_RULES} | {k: v[0] for k, v in OTHER_RULES.items()}
NEEDS_ALL = {r[0]: True for r in MESSAGE_RULES} | {k: v[3] for k, v in OTHER_RULES.items()}
#: Errors that end nothing.
BENIGN = ("failed to import AptClone", "failed to import apport python module", "_checkDep:", "has no priority set", "can not find failed maintainer script", "Can not open terminal log", "No snap store connectivity", "Failed fetching size of snap", "error reading from self.master_fd", "error setting default icon", "lspci failed", "os.path.realpath failed")
#: Causes outside the resolver, causes the resolver names, and words that corroborate causes.
ENVIRONMENT = ("not_enough_disk_space", "filesystem_not_writable", "cache_lock_failed", "ssh_upgrade_blocked", "esp_unusable", "unsupported_upgrade_path", "package_auth_failed", "download_failed", "update_failed", "view_depends_missing", "python_symlink_broken")
RESOLVER = ("third_party_pin", "unsatisfiable_virtual", "holdback_blocks_new_dep", "held_package_blocks_upgrade", "t64_transition", "i386_orphan", "exact_pin_broken_by_upgrade", "removal_cascade", "transitional_breaks")
CORROBORATION = (
    ("held broken packages", ("holdback_blocks_new_dep", "held_package_blocks_upgrade", "third_party_pin", "meta_package_uninstallable")),
    ("generated breaks", ("resolver_livelock", "transitional_breaks", "holdback_blocks_new_dep", "third_party_pin", "meta_package_uninstallable")),
    ("unmet dependencies", ("unsatisfiable_virtual", "exact_pin_broken_by_upgrade")),
)


@dataclass
class Corpus:
    """Parsed tables of many runs; a table that a corpus lacks is None and its rules find nothing.

    facts: run_key, evidence_complete, reached_dpkg, terminal_phase, phase_name, problem_type, traceback, duplicate_signature, missing_logs array<string>.
    records: run_key, seq, level, message.  apt_errors: run_key, text.  term: see ``terminal.failures``.
    roots: see ``conflicts.classify``.  oscillations: see ``ordered.oscillations``.  foreign: run_key, pkg.
    """

    facts: DataFrame
    records: DataFrame
    apt_errors: DataFrame | None = None
    term: DataFrame | None = None
    term_summary: DataFrame | None = None
    roots: DataFrame | None = None
    oscillations: DataFrame | None = None
    foreign: DataFrame | None = None
    options: dict = field(default_factory=dict)


def message_pattern(text: str) -> str:
    """Pattern of a message text: a blank is anything, the last one at the end all of the rest."""
    parts = [re.escape(p) for p in text.split("%s")]
    out = parts[0]
    for k, p in enumerate(parts[1:]):
        out += ("(.*)" if k == len(parts) - 2 and not p else "(.*?)") + p
    return out


def found(rule: str | Column, cause, summary, severity=None, confidence=None, roots=None, victims=None, size=None, graph=False, margin=None, fragile=None, detail=None) -> Column:
    """A finding, without its run, as a struct."""
    col = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    none = F.array().cast("array<string>")
    sev, conf = (severity if severity is not None else OTHER_RULES[rule][1]), (confidence if confidence is not None else OTHER_RULES[rule][2])
    return F.struct(
        col(rule, "string").alias("rule"), col(cause, "string").alias("cause"), col(summary, "string").alias("summary"), col(sev, "int").alias("severity"), col(conf, "int").alias("confidence"),
        (roots if roots is not None else none).alias("root_pkgs"), (victims if victims is not None else none).alias("victim_pkgs"), col(size if size is not None else 0, "int").alias("cascade_size"), F.lit(graph).alias("from_graph"),
        col(margin, "int").alias("score_margin"), col(fragile if fragile is not None else False, "boolean").alias("fragile"), (detail if detail is not None else F.create_map().cast("map<string,string>")).cast("map<string,string>").alias("detail"),
    )


def finding(rows: DataFrame, *args, **more) -> DataFrame:
    """(run_key, f): a finding a row."""
    return rows.select(F.col("run_key").cast("string").alias("run_key"), found(*args, **more).alias("f"))


# -- rules that read messages and facts: predicates, aggregates, findings ---------------------------------

FAILED, SHOWS, OPENING = "doUpdate() failed completely", "running doUpdate() (showErrors=", r"openCache\(\) failed: '(.*?)'"
INTERRUPTED, UNMARKED = "(?i)dpkg was interrupted, you must manually run", "failed to mark '%s' for install (%s)"


def said(c: Corpus) -> DataFrame:
    """(run_key, apt, seq, error, message): the lines that rules read, and the package manager's last words."""
    own = c.records.where((F.col("level") == "ERROR") | F.col("message").contains("doUpdate()"))
    own = own.select(F.col("run_key").cast("string").alias("run_key"), F.lit(False).alias("apt"), F.col("seq").cast("long").alias("seq"), (F.col("level") == "ERROR").alias("error"), "message")
    if c.apt_errors is None:
        return own
    return own.unionByName(c.apt_errors.select(F.col("run_key").cast("string").alias("run_key"), F.lit(True).alias("apt"), F.lit(None).cast("long").alias("seq"), F.lit(True).alias("error"), F.col("text").alias("message")))


def _has(message: Column, text: str) -> Column:
    """Whether a message has the text ``text``, whose blanks may be anything: its longest literal part is looked for first."""
    literal = max(text.split("%s"), key=len)
    return message.contains(literal) if "%s" not in text else message.contains(literal) & message.rlike(message_pattern(text))


def _first_text(texts) -> Column:
    """The first of a rule's message texts that a message has: struct<n, seq, values of its blanks>; else null."""
    tests = []
    for n, (text, *names) in enumerate(texts):
        pattern = message_pattern(text)
        values = F.array(*[F.trim(F.regexp_extract("message", pattern, i + 1)) for i in range(len(names))]).cast("array<string>")
        tests.append(F.when(_has(F.col("message"), text), F.struct(F.lit(n).alias("n"), "seq", values.alias("values"))))
    return F.coalesce(*tests)


def first_hits(lines: DataFrame) -> DataFrame:
    """One row a run: what each predicate met first (or last), all from one aggregation."""
    error, apt, message = F.col("error") & ~F.col("apt"), F.col("apt"), F.col("message")
    # only the package manager's words are lower-cased: what is named more than once is worked out for every line
    words_of_apt = F.lower(F.when(apt, message))
    hits = [F.min(F.when(error, _first_text(texts))).alias(f"m{k}") for k, (*_, texts) in enumerate(MESSAGE_RULES)]
    unmarked = message_pattern(UNMARKED)
    return lines.groupBy("run_key").agg(
        *hits,
        F.bool_or(F.col("error") & message.rlike(INTERRUPTED)).alias("interrupted"),
        F.max(F.when(message.contains(FAILED) & ~apt, F.col("seq"))).alias("failed_at"),
        F.collect_list(F.when(message.contains(SHOWS) & ~apt, F.struct("seq", message.contains(f"{SHOWS}True)").alias("shown")))).alias("shows"),
        F.min(F.when(error & message.rlike(OPENING), F.struct("seq", F.regexp_extract(message, OPENING, 1).alias("why")))).alias("unopened"),
        F.min(F.when(error & message.rlike(unmarked), F.struct("seq", F.trim(F.regexp_extract(message, unmarked, 1)).alias("package"), F.trim(F.regexp_extract(message, unmarked, 2)).alias("error")))).alias("unmarked"),
        F.bool_or(apt | (error & is_terminal_error(message))).alias("ended"),
        *[F.bool_or(F.coalesce(words_of_apt.contains(words), F.lit(False))).alias(f"c{k}") for k, (words, _) in enumerate(CORROBORATION)],
    )


def _message_finding(k: int) -> Column:
    rule, cause, severity, _, summary, texts = MESSAGE_RULES[k]
    hit, filled, detail = F.col(f"m{k}"), F.lit(summary), F.create_map().cast("map<string,string>")
    for n, (_, *names) in enumerate(texts):
        values = {name: F.get(hit["values"], F.lit(i)) for i, name in enumerate(names)}
        if all(f"{{{b}}}" not in summary or b in names for b in re.findall(r"\{(\w+)\}", summary)):
            said_so = F.lit(summary)
            for name, value in values.items():
                said_so = F.replace(said_so, F.lit(f"{{{name}}}"), value)
            filled = F.when(hit["n"] == n, said_so).otherwise(filled)
        if names:
            detail = F.when(hit["n"] == n, F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])).otherwise(detail)
    return F.when(hit.isNotNull(), found(rule, cause, filled, severity, STRONG, detail=detail))


def shared_findings() -> list[Column]:
    """The findings (null: none) of a run with its facts and first hits."""
    none = F.create_map().cast("map<string,string>")
    trace = F.try_element_at(F.filter(F.transform(F.split(F.coalesce("traceback", F.lit("")), "\n"), lambda p: F.trim(p)), lambda x: x != ""), F.lit(-1))
    # the last complete failure counts if the update it belongs to showed its errors (unknown: it did)
    before = F.array_max(F.filter(F.coalesce("shows", F.array().cast("array<struct<seq:bigint,shown:boolean>>")), lambda x: x["seq"] < F.col("failed_at")))
    fatal = F.col("failed_at").isNotNull() & F.coalesce(before["shown"], F.lit(True))
    why, package = F.col("unopened.why"), F.col("unmarked.package")
    missing = F.coalesce("missing_logs", F.array().cast("array<string>"))
    stops = F.when(F.size(missing) > 0, F.concat(F.lit("logs not provided: "), F.array_join(missing, ", "))).otherwise(F.concat(F.lit("the log stops during "), F.col("phase_name"), F.lit(" with no error recorded")))
    meta = F.when(package == "", "a required metapackage could not be installed").otherwise(F.concat(F.lit("the "), package, F.lit(" metapackage could not be installed")))
    crash = lambda x: found("upgrader.crash", "upgrader_crash", F.when(x == "", "the upgrader crashed").otherwise(F.concat(F.lit("the upgrader crashed: "), x)), detail=F.create_map(F.lit("exception"), x, F.lit("has_apport_signature"), (F.coalesce("duplicate_signature", F.lit("")) != "").cast("string")))
    return [
        *[_message_finding(k) for k in range(len(MESSAGE_RULES))],
        F.when(F.col("interrupted"), found("dpkg.interrupted", "dpkg_interrupted", "a previous dpkg run was interrupted, so the upgrade could not start", detail=F.create_map(F.lit("remedy_command"), F.lit("sudo dpkg --configure -a")))),
        F.when(F.col("problem_type") == "Crash", T.bound(F.coalesce(trace, F.lit("")), crash)),
        F.when(fatal | F.col("unopened").isNotNull(), found("net.update-failed", "update_failed", "refreshing the package lists failed", detail=F.when(~F.coalesce(fatal, F.lit(False)) & why.isNotNull(), F.create_map(F.lit("error"), why)).otherwise(none))),
        F.when(F.col("unmarked").isNotNull(), found("upgrader.metapkg-install-failed", "meta_package_uninstallable", meta, detail=F.create_map(F.lit("package"), package, F.lit("error"), F.col("unmarked.error")))),
        F.when(~F.col("evidence_complete"), found("evidence.truncated", "no_failure_recorded", F.concat(F.lit("no failure was recorded -- "), stops), detail=F.create_map(F.lit("terminal_phase"), F.col("phase_name")))),
        F.when(F.col("evidence_complete") & F.col("completed") & ~F.coalesce("ended", F.lit(False)), found("upgrader.no-failure", "upgrade_succeeded", "the upgrade completed; no failure was recorded")),
    ]


def message_rules(c: Corpus) -> DataFrame:
    """Of each rule the first message text that any error has, and its first error."""
    hits = first_hits(said(c)).select("run_key", F.explode(F.filter(F.array(*[_message_finding(k) for k in range(len(MESSAGE_RULES))]), lambda f: f.isNotNull())).alias("f"))
    return hits.select("run_key", "f.*")


# -- rules over other tables -------------------------------------------------------------------------------


def dpkg_failures(c: Corpus) -> DataFrame | None:
    """One finding for each package that failed by itself; the hook's package is blamed where a hook failed."""
    if c.term is None:
        return None
    rows = c.term.where("kind <> 'dependency'")
    if c.term_summary is not None:
        rows = rows.join(c.term_summary.groupBy("run_key").agg(F.collect_list("package").alias("all")), "run_key", "left")
    else:
        rows = rows.withColumn("all", F.array().cast("array<string>"))
    rows = rows.withColumn("victims", F.filter(F.coalesce("all", F.array().cast("array<string>")), lambda p: p != F.col("package")))
    culprit = F.coalesce(F.nullif(F.col("blamed_package"), F.lit("")), F.nullif(F.col("package"), F.lit("")), F.col("archive"))
    n = F.size("victims")
    tail = F.when(n == 0, "").otherwise(F.concat(F.lit(", leaving "), n.cast("string"), F.when(n == 1, " package").otherwise(" packages"), F.lit(" unconfigured")))
    status = F.when(F.col("exit_status") == 0, "").otherwise(F.concat(F.lit(" (exit status "), F.col("exit_status").cast("string"), F.lit(")")))
    summary = (
        F.when(F.col("kind") == "file-conflict", F.concat(culprit, F.lit(" tries to overwrite "), F.col("conflicting_path"), F.lit(", which belongs to "), F.col("conflicting_package")))
        .when(F.col("kind") == "unpack", F.concat(culprit, F.lit(" could not be unpacked"), tail))
        .when((F.col("blamed_package") != "") & (F.col("blamed_package") != F.col("package")), F.concat(F.col("package"), F.lit("'s maintainer script failed while running a hook from "), F.col("blamed_package"), tail))
        .otherwise(F.concat(culprit, F.lit("'s maintainer script failed"), status, tail))
    )
    cause = F.when(F.col("kind").isin("file-conflict", "unpack"), "dpkg_unpack_overwrite").otherwise("dpkg_maintscript_failed")
    detail = F.map_filter(F.create_map(F.lit("action"), F.col("action"), F.lit("reason"), F.col("reason"), F.lit("kind"), F.col("kind"), F.lit("named_by_hook"), F.col("blamed_package"), F.lit("conflicts_with"), F.col("conflicting_package"), F.lit("path"), F.col("conflicting_path"), F.lit("exit_status"), F.nullif(F.col("exit_status"), F.lit(0)).cast("string"), F.lit("failing_package"), F.when(F.col("blamed_package") != "", F.col("package"))), lambda k, v: v.isNotNull() & (v != ""))
    return finding(rows, "dpkg.failures", cause, summary, roots=F.array(culprit), victims=F.col("victims"), size=n, detail=detail)


#: What is said of a root, by cause.
ROOT_TEXTS = {
    "third_party_pin": "{p} comes from outside Ubuntu and cannot be upgraded", "holdback_blocks_new_dep": "apt held {p} back", "held_package_blocks_upgrade": "{p} is held at its current version",
    "exact_pin_broken_by_upgrade": "{p} requires {c}, which the upgrade does not provide", "unsatisfiable_virtual": "nothing in resolute provides {p}", "i386_orphan": "{p} is i386 and has no 26.04 counterpart",
    "t64_transition": "{p} is caught in the 64-bit time_t transition", "removal_cascade": "removing {p} would cascade", "transitional_breaks": "{p} conflicts with its own replacement",
}


def _filled(texts: dict[str, str], cause: Column, blanks: dict[str, Column], other: str) -> Column:
    def fill(text: str) -> Column:
        parts = re.split(r"(\{\w+\})", text)
        return F.concat(*[blanks[p[1:-1]] if p.startswith("{") and p[1:-1] in blanks else F.lit(p) for p in parts if p])

    return reduce(lambda out, kv: F.when(cause == kv[0], fill(kv[1])).otherwise(out), texts.items(), fill(other))


def resolver_roots(c: Corpus) -> DataFrame | None:
    if c.roots is None:
        return None
    p = T.package_label(F.col("pkg"))
    n = F.col("cascade_size")
    tail = F.when(n == 0, "").otherwise(F.concat(F.lit(", blocking "), n.cast("string"), F.when(n == 1, " package").otherwise(" packages")))
    body = _filled(ROOT_TEXTS, F.col("cause"), {"p": p, "c": F.coalesce(F.nullif(F.col("constraint"), F.lit("")), F.lit("an exact version"))}, "{p} could not be resolved")
    severity = F.when(F.col("cause").isin("third_party_pin", "i386_orphan", "t64_transition"), HIGH).otherwise(F.col("severity"))
    more = F.map_filter(F.create_map(F.lit("constraint"), F.nullif(F.col("constraint"), F.lit("")), F.lit("cycle_broken"), F.when(F.col("cycle_broken"), "true")), lambda k, v: v.isNotNull())
    return finding(c.roots, "resolver.roots", F.col("cause"), F.concat(body, tail), severity, F.col("confidence"), F.array("pkg"), F.col("cascade"), n, True, F.col("score_margin"), F.col("fragile"), F.map_concat("detail", more))


def shown(names: Column, most: int) -> Column:
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(n > most, F.concat(head, F.lit(" and "), (n - most).cast("string"), F.lit(" more"))).otherwise(head)


def fragile_decision(c: Corpus) -> DataFrame | None:
    if c.roots is None:
        return None
    rows = c.roots.where("fragile and score_margin is not null").groupBy("run_key").agg(F.array_sort(F.collect_list(F.struct("score_margin", (-F.col("cascade_size")).alias("m"), "rank", "pkg", "cause"))).alias("x"))
    names, first = F.transform("x", lambda r: T.package_label(r["pkg"])), F.col("x")[0]
    s = F.concat(F.lit("apt decided "), F.size("x").cast("string"), F.lit(" of these by a margin of "), first["score_margin"].cast("string"), F.when(first["score_margin"] == 1, " point").otherwise(" points"), F.lit(" or less ("), shown(names, 3), F.lit("), so the outcome depends on the reporter's exact package set"))
    return finding(rows, "resolver.fragile-decision", first["cause"], s, roots=F.transform("x", lambda r: r["pkg"]), margin=first["score_margin"], fragile=True, detail=F.create_map(F.lit("fragile_packages"), F.array_join(names, ", "), F.lit("narrowest_margin"), first["score_margin"].cast("string"), F.lit("advisory"), F.lit("true")))


def third_party_blocker(c: Corpus) -> DataFrame | None:
    if c.roots is None or c.foreign is None:
        return None
    own = c.roots.join(c.foreign.select(F.col("run_key").cast("string").alias("run_key"), "pkg").distinct(), ["run_key", "pkg"], "left_semi")
    rows = own.groupBy("run_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("cascade_size")).alias("m"), "rank", "pkg", "cascade"))).alias("x"))
    names, victims = F.transform("x", lambda r: T.package_label(r["pkg"])), F.array_distinct(F.flatten(F.transform("x", lambda r: r["cascade"])))
    n = F.size(victims)
    s = F.concat(F.lit("packages from outside Ubuntu block the upgrade: "), shown(names, 3), F.lit(" ("), n.cast("string"), F.when(n == 1, " package").otherwise(" packages"), F.lit(" affected)"))
    return finding(rows, "resolver.third-party-blocker", "third_party_pin", s, roots=F.transform("x", lambda r: r["pkg"]), victims=victims, size=n, graph=True, detail=F.create_map(F.lit("third_party_packages"), F.array_join(names, ", "), F.lit("candidate_invalid"), F.lit("true")))


def resolver_livelock(c: Corpus) -> DataFrame | None:
    if c.oscillations is None:
        return None
    o = c.oscillations.where("is_terminal")
    rows = o.groupBy("run_key", F.coalesce("blocked_by", "subject").alias("blocker")).agg(F.array_sort(F.collect_list(F.struct((-F.col("reversals")).alias("m"), "subject"))).alias("x"), F.array_sort(F.collect_set("forced_by")).alias("by"), F.max("reversals").alias("worst"))
    names, b = F.transform("x", lambda r: T.package_label(r["subject"])), T.package_label(F.col("blocker"))
    stuck = shown(names, 2)
    forced = F.concat(F.lit("apt could not converge: "), T.package_label(F.coalesce(F.get("by", F.lit(0)), F.lit(""))), F.lit(" requires a newer "), stuck, F.lit(", but that needs "), b, F.lit(", which apt refused to install -- reversed "), F.col("worst").cast("string"), F.lit(" times before giving up"))
    plain = F.concat(F.lit("apt could not converge on "), stuck, F.lit(" because it refused to install "), b, F.lit(", reversing "), F.col("worst").cast("string"), F.lit(" times"))
    detail = F.map_filter(F.create_map(F.lit("oscillating_package"), names[0], F.lit("oscillating_packages"), F.array_join(names, ", "), F.lit("reversals"), F.col("worst").cast("string"), F.lit("blocked_by"), b, F.lit("forced_by"), F.get("by", F.lit(0))), lambda k, v: v.isNotNull())
    return finding(rows, "resolver.livelock", "resolver_livelock", F.when(F.size("by") > 0, forced).otherwise(plain), roots=F.array("blocker"), victims=F.transform("x", lambda r: r["subject"]), graph=True, detail=detail)


def is_terminal_error(message: Column) -> Column:
    return ~reduce(lambda a, b: a | b, [message.contains(t) for t in BENIGN])


Rule = Callable[[Corpus], DataFrame | None]
#: The rules over other tables.
RULES: list[Rule] = [dpkg_failures, resolver_livelock, resolver_roots, third_party_blocker, fragile_decision]


def rules_digest() -> str:
    """Names the policy: any change of a rule's name, cause, order or weight changes it."""
    return hashlib.sha256(repr((MESSAGE_RULES, sorted(OTHER_RULES.items()))).encode()).hexdigest()[:16]


def tier(f: Column, completed: Column) -> Column:
    """The band of a finding; lower ones are more authoritative."""
    c = f["cause"]
    early = f["from_graph"] | c.isin(*RESOLVER, "resolver_livelock", "meta_package_uninstallable")
    return (
        F.when(c == "no_failure_recorded", 99).when(f["rule"] == "resolver.fragile-decision", 50).when(completed & early, 40)
        .when(c.isin("dpkg_interrupted", "upgrader_crash"), 0).when(c.isin(*ENVIRONMENT), 1).when(c == "resolver_livelock", 2).when(c == "meta_package_uninstallable", 3).otherwise(4)
    )


def _corroborated(f: Column) -> Column:
    """Whether the package manager's own last words point to the cause."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"c{k}"), F.lit(False)) & f["cause"].isin(*causes) for k, (_, causes) in enumerate(CORROBORATION)])


def _once(all_: Column) -> Column:
    """Of findings with one rule, cause and roots that with the larger cascade, then the lesser summary."""
    keyed = F.transform(all_, lambda f, i: F.struct(f["rule"].alias("r"), f["cause"].alias("c"), F.array_join(f["root_pkgs"], ",").alias("p"), (-f["cascade_size"]).alias("n"), f["summary"].alias("s"), i.alias("i")))
    same = lambda a, b: (a["r"] == b["r"]) & (a["c"] == b["c"]) & (a["p"] == b["p"])
    kept = lambda xs: F.filter(xs, lambda x, i: (i == 0) | ~same(x, F.get(xs, i - 1)))
    return T.bound(F.array_sort(keyed), lambda xs: F.transform(kept(xs), lambda x: F.get(all_, x["i"])))


def ranked(all_: Column, limit: int) -> Column:
    """array<struct<f, tier, corroborated, priority, rank>>: the first ``limit`` findings in order, then the caveats beyond."""
    priorities = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    keyed = F.transform(all_, lambda f, i: F.struct(tier(f, F.col("completed")).alias("tier"), (-f["severity"]).alias("s"), (~_corroborated(f)).alias("u"), (-f["cascade_size"]).alias("n"), F.coalesce(priorities[f["rule"]], F.lit(500)).alias("priority"), (-f["confidence"]).alias("c"), f["rule"].alias("r"), f["summary"].alias("t"), i.alias("i")))
    told = F.transform(F.array_sort(keyed), lambda x, n: F.struct(F.get(all_, x["i"]).alias("f"), x["tier"].alias("tier"), (~x["u"]).alias("corroborated"), x["priority"].alias("priority"), F.least(n + 1, F.lit(limit + 1)).alias("rank")))
    return F.filter(told, lambda x: (x["rank"] <= limit) | (x["f"]["cause"] == "no_failure_recorded"))


def diagnose(c: Corpus, enabled: list[str] | None = None, disabled: list[str] = [], limit: int = 12, rules: list[Rule] | None = None) -> DataFrame:  # noqa: B006
    """Ranked findings of every run; repeats of (rule, cause, roots) keep the larger cascade.

    Rules that need complete evidence say nothing of runs without; the first ``limit`` stay, and
    caveats always.  ``rules`` (default: ``RULES``) are those over other tables.
    """
    facts = c.facts.withColumn("run_key", F.col("run_key").cast("string")).withColumn("completed", F.coalesce("reached_dpkg", F.lit(False)) & F.coalesce(F.col("terminal_phase") >= POST_UPGRADE, F.lit(False)))
    runs = facts.join(first_hits(said(c)), "run_key", "left")
    all_ = F.filter(F.array(*shared_findings()), lambda f: f.isNotNull())
    parts = [p for p in (r(c) for r in (RULES if rules is None else rules)) if p is not None]
    if parts:
        others = reduce(lambda a, b: a.unionByName(b), parts).groupBy("run_key").agg(F.collect_list("f").alias("others"))
        runs = runs.join(others, "run_key", "left")
        all_ = F.concat(all_, F.coalesce("others", F.array()))
    needs = [name for name, all_logs in NEEDS_ALL.items() if not all_logs]
    stays = lambda f: F.col("evidence_complete") | f["rule"].isin(*needs)
    on = lambda f: reduce(lambda a, b: a & b, [stays(f), *([f["rule"].isin(*enabled)] if enabled is not None else []), *([~f["rule"].isin(*disabled)] if disabled else [])])
    clear = runs.select("run_key", "completed", *[f"c{k}" for k in range(len(CORROBORATION))], T.bound(F.filter(all_, on), _once).alias("all"))
    told = clear.select("run_key", F.explode(ranked(F.col("all"), limit)).alias("x"))
    return told.select("run_key", "x.f.*", "x.tier", "x.corroborated", "x.priority", "x.rank")


def primary(findings: DataFrame) -> DataFrame:
    """The first finding of each run that is no caveat."""
    rest = findings.where("cause <> 'no_failure_recorded'")
    return rest.groupBy("run_key").agg(F.min_by(F.struct(*[c for c in rest.columns if c != "run_key"]), "rank").alias("x")).select("run_key", "x.*")


#: Titles by cause.
TITLES = {
    "third_party_pin": "third-party {p2} cannot be upgraded{blocking}", "holdback_blocks_new_dep": "{p} held back{blocking}", "held_package_blocks_upgrade": "{p} is held and blocks {n}", "unsatisfiable_virtual": "nothing provides {p}{breaking}",
    "i386_orphan": "i386 {p} has no counterpart, breaking {n}", "t64_transition": "{p} is stuck in the 64-bit time_t transition", "removal_cascade": "removing {p} would remove {n}", "transitional_breaks": "{p} conflicts with its own replacement",
    "dpkg_interrupted": "a previous dpkg run was interrupted and must be repaired first", "package_auth_failed": "packages could not be authenticated", "download_failed": "the upgrade could not be downloaded", "update_failed": "refreshing the package lists failed",
    "cache_lock_failed": "another package manager holds the apt lock", "ssh_upgrade_blocked": "the upgrade was refused over SSH", "esp_unusable": "the EFI system partition is not usable", "unsupported_upgrade_path": "this upgrade path is not supported",
    "upgrade_succeeded": "the upgrade completed with no error recorded", "broken_packages_after_upgrade": "{n} left broken after the upgrade", "unknown": "an unrecognised resolver decision about {p}{affecting}",
}


def title(limit: int = 120) -> Column:
    """The cause-specific title of a finding, from its columns."""
    names = F.transform("root_pkgs", T.package_label)
    p, n, d = F.coalesce(F.get(names, F.lit(0)), F.lit("an unknown package")), F.col("cascade_size"), F.col("detail")
    count = F.concat(n.cast("string"), F.when(n == 1, " package").otherwise(" packages"))
    tail = lambda word: F.when(n == 0, "").otherwise(F.concat(F.lit(word), count))
    more = F.when(F.size(names) > 2, F.concat(F.lit(" and "), (F.size(names) - 2).cast("string"), F.lit(" others"))).otherwise("")
    blanks = {"p": p, "n": count, "p2": F.concat(F.array_join(F.slice(names, 1, 2), ", "), more), "blocking": tail(", blocking "), "breaking": tail(", breaking "), "affecting": tail(" affecting ")}
    has = lambda k: F.coalesce(d[k], F.lit("")) != ""
    said = lambda k, text, other: F.when(has(k), F.concat(*[F.col("detail")[x[1:-1]] if x.startswith("{") and x != "{p}" else p if x == "{p}" else F.lit(x) for x in re.split(r"(\{\w+\})", text) if x])).otherwise(F.concat(*[p if x == "{p}" else F.lit(x) for x in re.split(r"(\{p\})", other) if x]))
    special = {
        "resolver_livelock": said("oscillating_package", "apt deadlocks on {oscillating_package} needing {p}", "apt cannot converge without installing {p}"),
        "exact_pin_broken_by_upgrade": F.concat(said("constraint", "{p} requires {constraint} which is unavailable", "{p} has an unsatisfiable version requirement"), tail(", breaking ")),
        "dpkg_maintscript_failed": F.when(has("failing_package") & (d["failing_package"] != p), F.concat(d["failing_package"], F.lit(" fails to configure because of a hook from "), p)).otherwise(said("exit_status", "{p} maintainer script fails (exit {exit_status})", "{p} maintainer script fails")),
        "dpkg_unpack_overwrite": F.when(has("conflicts_with") & has("path"), F.concat(p, F.lit(" overwrites "), d["path"], F.lit(" owned by "), d["conflicts_with"])).otherwise(F.concat(p, F.lit(" cannot be unpacked"))),
        "not_enough_disk_space": said("required", "not enough disk space: {required}", "not enough disk space"),
        "meta_package_uninstallable": said("package", "the {package} metapackage cannot be installed", "a required metapackage cannot be installed"),
        "filesystem_not_writable": said("path", "cannot write to {path}", "a required path is not writable"),
        "upgrader_crash": said("exception", "the upgrader crashes: {exception}", "the upgrader crashes"),
        "post_install_script_error": said("script", "post-install script {script} fails", "a post-install script fails"),
        "no_failure_recorded": F.when(has("terminal_phase") & (d["terminal_phase"] != "UNKNOWN"), F.concat(F.lit("logs end during "), d["terminal_phase"], F.lit(" with no failure recorded"))).otherwise(F.lit("the attached logs record no failure")),
    }
    out = _filled(TITLES, F.col("cause"), blanks, "{p} could not be resolved{affecting}")
    for cause, text in special.items():
        out = F.when(F.col("cause") == cause, text).otherwise(out)
    return T.trim_title(out, limit)


def class_titles(findings: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, title): of a class's titles the surest, then the one with most roots, then the shortest."""
    top = primary(findings).withColumn("title", title())
    known = members.join(top.where("title <> ''"), "run_key")
    sure = (F.col("confidence") >= STRONG).cast("int")
    best = F.struct((-sure).alias("a"), (-F.size("root_pkgs")).alias("b"), F.length("title").alias("c"), "title")
    return known.groupBy("cluster").agg(F.min_by("title", best).alias("title"))
