"""Lines of a dependency resolver's trace, told apart by phrase.

Phrases are written as templates and compiled to anchored patterns; a line's first
phrase wins.  A line is dispatched by its first word, so it meets the one to three patterns that can open so, and the one that
has no opening.  A pattern is matched once: the line is replaced by its fields, parted by a control character, and then
split.  Everything is a built-in expression.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import states as S
from ..functions import text as T

MOST_LINE = 8192
#: Parts the fields of a parsed line, and opens it.
MARK = "\x01"

#: Verb, stream, phrase.  {a} {b} {c} are package references, {dep} a relation's
#: name in any language, {v} an optional version in brackets, {n} a number.  A blank is any white space.
PHRASES = (
    ("log_time", "section", r"Log time:\s*(?P<timestamp>.+)"),
    ("starting", "resolver", "Starting(?: {n})? pkgProblemResolver with broken count:\\s*(?P<broken>\\d+)"),
    ("entering_resolve_by_keep", "resolver", "Entering ResolveByKeep"),
    ("done", "resolver", "Done"),
    ("broken", "resolver", "Broken {a} {dep} on {b}{v}"),
    ("investigating", "resolver", r"Investigating \({n}\) {a}"),
    ("deps_not_satisfied", "resolver", "Dependencies are not satisfied for {a}"),
    ("considering", "resolver", r"Considering {a} (?P<score_src>-?\d+) as a solution to {b} (?P<score_dst>-?\d+)"),
    ("holding_back", "resolver", "Holding Back {a} rather than change {b}"),
    ("removing_rather", "resolver", "Removing {a} rather than change {b}"),
    ("fixing_via_remove", "resolver", "Fixing {a} via remove of {b}"),
    ("fixing_via_keep", "resolver", "Fixing {a} via keep of {b}"),
    ("added_to_remove_list", "resolver", "Added {a} to the remove list"),
    ("keeping_package", "resolver", r"Keeping [Pp]ackage {a}(?: due to (?P<dep>\S+))?"),
    ("package_dep", "resolver", r"Package {a} [^\s<>]+ {dep} on {b}{v}"),
    ("delayed_removing", "resolver", "Delayed Removing: {a} as upgrade is not an option for {b}{v}"),
    ("removing_not_possible", "resolver", "Removing: {a} as upgrade is not (?:possible|an option for {b}{v})"),
    ("setting_not_auto", "autoinstall", r"Setting {a} NOT as auto-installed \(direct {dep} of {b} which is in [\w:.-]+\)"),
    ("reinst_failed", "resolver", "Reinst Failed because of {a}"),
    ("try_reinstate", "resolver", r"Try to Re-?Instate \({n}\) {a}"),
    ("reinstated", "resolver", r"Re-?Instated {a}(?: \(-?\d+ vs -?\d+\))?"),
    ("ignore_not_instver", "resolver", r"Conflicts//Breaks against version (?P<constraint>\S+) for {a} but that is not InstVer,\s*ignoring"),
    ("try_installing_before", "resolver", "Try Installing {a} before changing {b}"),
    ("ignore_mark_keep_protected", "resolver", r"Ignore Mark(?:Keep|Install|Delete|Garbage) of {a} as its mode \(\w+\) is protected"),
    ("or_group_keep", "resolver", "Or group keep for {a}"),
    ("or_group_remove", "resolver", "Or group remove for {a}"),
    ("mark_install", "marker", "MarkInstall {a}{fu}"),
    ("mark_delete", "marker", "MarkDelete {a}{fu}"),
    ("mark_keep", "marker", "MarkKeep {a}{fu}"),
    ("mark_purge", "marker", "MarkPurge {a}{fu}"),
    ("installing_as", "autoinstall", "Installing {a} as {dep} of {b}"),
    ("upgrading_due_to_dep", "autoinstall", "Upgrading: {a} due to {b} {dep} on {c}{v}"),
    ("upgrading_due_to_field", "autoinstall", "Upgrading:? {a} due to {dep} field in {b}"),
    ("upgrading_due_to", "autoinstall", "Upgrading:? {a} due to {b}"),
    ("ignore_old_unsatisfied", "autoinstall", "ignore old unsatisfied (?:important )?dependency on {a}"),
    ("new_important_dep", "autoinstall", r"new important dependency:\s*{a}"),
    ("previously_satisfied", "autoinstall", "previously satisfied (?:important )?dependency on {a}"),
    ("removing", "marker", "Removing {a}"),
    ("cant_be_satisfied", "resolver", r"{a} {dep} on {b}{v} can't be satisfied!(?: \(dep\))?"),
)
BLANKS = {
    "{a}": r"(?P<subject>[^\s<>()]+)", "{b}": r"(?P<object>[^\s<>()]+)", "{c}": r"(?P<third>[^\s<>()]+)",
    "{dep}": r"(?P<dep>[^<>()\s][^<>]*?)", "{v}": r"(?: \((?P<constraint>[^)]*)\))?", "{n}": r"(?P<pass_no>\d+)", "{fu}": "(?: FU=(?P<fu>[01]))?",
}
#: Relation names and their codes.
DEPENDENCIES = {"recommends": 1, "suggests": 2, "replaces": 3, "breaks": 4, "conflicts": 5, "depends": 6, "predepends": 7, "pre-depends": 7}
FIELDS = ["verb", "subject", "object", "third", "dep", "constraint", "score_src", "score_dst", "broken_count", "pass_no", "from_user", "timestamp"]
SCHEMA = "verb string, subject string, object string, third string, dep string, constraint string, score_src int, score_dst int, broken_count int, pass_no int, from_user boolean, timestamp string"
CONFLICTS = ("broken", "cant_be_satisfied", "deps_not_satisfied", "package_dep")
DECISIONS = ("holding_back", "removing_rather", "fixing_via_remove", "fixing_via_keep", "added_to_remove_list", "keeping_package", "delayed_removing", "try_installing_before")
KEEPS, UPGRADES = ("holding_back", "mark_keep"), ("upgrading_due_to", "upgrading_due_to_field", "upgrading_due_to_dep")


#: Groups of the patterns, in the order in which a parsed line has them after its verb.
GROUPS = ["subject", "object", "third", "dep", "constraint", "score_src", "score_dst", "broken", "pass_no", "fu", "timestamp"]


def _openings(phrase: str) -> list[str] | None:
    """The first words a phrase can open with; None where that is a blank."""
    word = re.split(r"[ (\\]", phrase)[0]
    if word.startswith("{"):
        return None
    return [word] if "?" not in word else [re.sub(r".\?", "", word), word.replace("?", "")]


def _longest(phrase: str) -> str:
    """The longest run of letters in a phrase: no line fits the phrase without it."""
    return max(re.findall(r"[A-Za-z']+", re.sub(r"\{\w+\}|\(\?.*", " ", phrase)), key=len)


def _replacement(verb: str, phrase: str) -> tuple[str, str]:
    """(anchored pattern, what a line that fits is replaced by)."""
    for blank, pattern in BLANKS.items():
        phrase = phrase.replace(blank, pattern)
    names = re.findall(r"\(\?P<(\w+)>", phrase)
    pattern = re.sub(r"\(\?P<\w+>", "(", phrase).replace(" ", r"\s+")
    return f"^(?!{MARK})(?:{pattern})$", MARK.join(["", verb, *(f"${names.index(g) + 1}" if g in names else "" for g in GROUPS)])


def parsed(skeleton: Column) -> Column:
    """struct of ``SCHEMA`` of a line without its states."""
    by_opening: dict[str, list[tuple[str, str]]] = {}
    rest = []
    for verb, _, phrase in PHRASES:
        for opening in (own := _openings(phrase)) or []:
            by_opening.setdefault(opening, []).append((verb, phrase))
        rest += [(verb, phrase)] if own is None else []
    shared: dict[tuple, list[str]] = {}
    for opening, own in by_opening.items():
        shared.setdefault(tuple(own), []).append(opening)
    apply = lambda line, own: reduce(lambda x, vp: F.regexp_replace(x, *_replacement(*vp)), own, line)

    def dispatched(x: Column) -> Column:
        first, line = x["first"], x["line"]
        cases = [(first.isin(*openings), apply(line, own)) for own, openings in shared.items()]
        return reduce(lambda w, c: w.when(*c), cases[1:], F.when(*cases[0])).otherwise(line)

    def replaced(verb: str, phrase: str):
        return lambda x: F.when(x.contains(_longest(phrase)), F.regexp_replace(x, *_replacement(verb, phrase))).otherwise(x)

    def fields(x: Column) -> Column:
        text = lambda g: F.coalesce(F.get(x, F.lit(GROUPS.index(g) + 2)), F.lit(""))
        # a failed cast costs an exception, so what is empty isn't cast
        number = lambda g: F.when(text(g) != "", text(g).try_cast("int"))
        known = F.size(x) > 1
        return F.struct(
            F.when(known, F.get(x, F.lit(1))).otherwise("unknown").alias("verb"), text("subject").alias("subject"), text("object").alias("object"), text("third").alias("third"), text("dep").alias("dep"), F.trim(text("constraint")).alias("constraint"),
            number("score_src").alias("score_src"), number("score_dst").alias("score_dst"), number("broken").alias("broken_count"), number("pass_no").alias("pass_no"), F.when(text("fu") != "", text("fu") == "1").alias("from_user"), F.trim(text("timestamp")).alias("timestamp"),
        )

    opened = T.bound(F.coalesce(skeleton, F.lit("")), lambda line: T.bound(F.struct(line.alias("line"), F.substring_index(line, " ", 1).alias("first")), dispatched))
    for verb, phrase in rest:
        opened = T.bound(opened, replaced(verb, phrase))
    return T.bound(F.split(opened, MARK), fields)


def dependency_code(name: Column, aliases: dict[str, int] | None = None) -> Column:
    """Code of a relation's name; ``aliases`` adds further languages' names."""
    table = DEPENDENCIES | (aliases or {})
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(F.trim(name))], F.lit(0))


def lex(lines: DataFrame, text: str = "line", aliases: dict[str, int] | None = None) -> DataFrame:
    """``lines`` with the fields of each resolver line; blank and oversized lines are ``unknown`` and told by ``shape``."""
    line = F.col("_line")
    blank, large = F.trim(line) == "", F.length(line) > MOST_LINE
    bare = F.when(blank | large, "").otherwise(S.skeleton(line))
    streams = F.create_map(*[F.lit(x) for v, s, _ in PHRASES for x in (v, s)])
    out = lines.withColumn("_line", F.regexp_replace(text, r"\s+$", "")).withColumn("_p", parsed(bare))
    return out.select(
        *lines.columns,
        T.indent_depth(F.col(text)).alias("depth"),
        *[F.col(f"_p.{f}").alias(f) for f in FIELDS if f != "dep"],
        dependency_code(F.col("_p.dep"), aliases).alias("dep"),
        F.coalesce(streams[F.col("_p.verb")], F.lit("unknown")).alias("stream"),
        F.when(blank | large, F.array().cast("array<struct<raw:string,cur_version:string,cand_version:string,selection:int,mode:int,status:string,bits:int,unknown_tokens:array<string>>>")).otherwise(S.states(line)).alias("states"),
        F.when(blank, "blank").when(large, "oversized").when(F.col("_p.verb") == "unknown", "unmatched").otherwise("matched").alias("shape"),
    )


def coverage(tokens: DataFrame, key: list[str] = ["run_key"]) -> DataFrame:  # noqa: B006
    """Per run: lines, matched, blank, oversized, unmatched, coverage (all that is accounted for over all lines)."""
    n = lambda s: F.count_if(F.col("shape") == s)
    return tokens.groupBy(*key).agg(
        F.count(F.lit(1)).alias("lines"), n("matched").alias("matched"), n("blank").alias("blank"), n("oversized").alias("oversized"), n("unmatched").alias("unmatched"),
        F.when(F.count(F.lit(1)) == 0, 1.0).otherwise((F.count(F.lit(1)) - n("unmatched")) / F.count(F.lit(1))).alias("coverage"),
    )


def verb_counts(tokens: DataFrame, key: list[str] = ["run_key"]) -> DataFrame:  # noqa: B006
    return tokens.where("verb <> 'unknown'").groupBy(*key, "verb").count().withColumnRenamed("count", "n")


def unknown_shapes(tokens: DataFrame, text: str = "line", limit: int = 20) -> DataFrame:
    """The most frequent masked lines that no phrase fits."""
    lines = tokens.where("shape = 'unmatched'").groupBy(text).count()
    return lines.select(T.mask(F.col(text))["template"].alias("template"), "count").groupBy("template").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "template").limit(limit)


def unknown_shapes_by_run(tokens: DataFrame, text: str = "line", limit: int = 20) -> DataFrame:
    """(run_key, unknown_shapes array<struct<template, count>>): each run's ``limit`` most frequent; a line is masked once."""
    lines = tokens.where("shape = 'unmatched'").select("run_key", text)
    masked = lines.select(text).distinct().select(text, T.mask(F.col(text))["template"].alias("template"))
    counts = lines.join(masked, text).groupBy("run_key", "template").count()
    first = counts.withColumn("_n", F.row_number().over(Window.partitionBy("run_key").orderBy(F.desc("count"), "template"))).where(F.col("_n") <= limit)
    ranked = first.groupBy("run_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "template"))).alias("x"))
    return ranked.select("run_key", F.transform("x", lambda s: F.struct(s["template"].alias("template"), (-s["n"]).alias("count"))).alias("unknown_shapes"))


def trace_sections(tokens: DataFrame) -> DataFrame:
    """Sections of a resolver trace (see ``ordered.sections``)."""
    from .ordered import sections

    verb = F.col("verb")
    content = F.concat_ws("|", "verb", "subject", "object", "third", F.col("dep").cast("string"), "constraint")
    return sections(tokens, verb == "log_time", ["run_key"], ["line_no"], verb.isin(*CONFLICTS), verb.isin(*DECISIONS), F.when(verb == "starting", F.col("broken_count")), verb == "done", content, verb == "entering_resolve_by_keep")

