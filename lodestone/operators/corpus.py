"""Queries over the whole corpus of runs: histograms, look-ups, self-joins, top lists."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, value: Column, name: str, where: Column | None = None) -> DataFrame:
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def coverage_totals(runs: DataFrame, lines: str = "lex_lines", unmatched: str = "lex_unmatched") -> DataFrame:
    measured = runs.where(F.col(lines) > 0)
    return measured.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum(F.when(F.col(unmatched) == 0, 1).otherwise(0)), F.lit(0)).alias("perfect"), F.coalesce(F.sum(lines), F.lit(0)).alias("lines"), F.coalesce(F.sum(unmatched), F.lit(0)).alias("unmatched"))


def imperfect(runs: DataFrame, key: str = "run_key", lines: str = "lex_lines", unmatched: str = "lex_unmatched") -> DataFrame:
    return runs.where((F.col(lines) > 0) & (F.col(unmatched) > 0)).select(key, lines, unmatched).orderBy(F.desc(unmatched), key)


def unmeasured(runs: DataFrame, key: str = "run_key") -> DataFrame:
    return runs.where("lex_lines = 0 and coalesce(tool_version, '') = ''").select(key)


def top_counts(rows: DataFrame, by: list[str], limit: int, distinct: str | None = None, name: str = "n") -> DataFrame:
    """The most frequent groups; ties by the group itself, so that the list is the same every time."""
    n = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias(name)).orderBy(F.desc(name), *by).limit(limit)


def unclassified_templates(run_templates: DataFrame, runs: DataFrame, limit: int = 50) -> DataFrame:
    open_ = runs.where("top_cause is null or top_cause in ('unknown', 'no_failure_recorded')").select("run_key")
    return top_counts(run_templates.join(open_, "run_key", "left_semi"), ["template"], limit)


def sharing(rows: DataFrame, key: str, item: str, least: int, queries: DataFrame) -> DataFrame:
    """(key, other, shared): who has at least ``least`` items in common with each of ``queries`` (a column of keys)."""
    have = rows.select(key, item).distinct()
    asked = have.join(queries.select(F.col(queries.columns[0]).alias(key)).distinct(), key, "left_semi")
    both = asked.join(have.withColumnRenamed(key, "other"), item).where(F.col(key) != F.col("other"))
    return both.groupBy(key, "other").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def related(signatures: DataFrame, shared_roots: DataFrame, queries: DataFrame, key: str = "run_key") -> DataFrame:
    """(key, other, how) of each of ``queries`` (a column of keys): equal graphs; else equal causes; else shared roots."""
    asked = signatures.join(queries.select(F.col(queries.columns[0]).alias(key)).distinct(), key, "left_semi")
    pair = lambda c: asked.where(F.col(c).isNotNull()).select(key, c).join(signatures.select(F.col(key).alias("other"), c), c).where(F.col(key) != F.col("other")).select(key, "other")
    exact = pair("root_graph")
    cause = pair("cause_tuple").join(exact, [key, "other"], "left_anti")
    roots = shared_roots.select(key, "other").join(exact, [key, "other"], "left_anti").join(cause, [key, "other"], "left_anti")
    tag = lambda d, how: d.withColumn("how", F.lit(how))
    return tag(exact, "root-graph").unionByName(tag(cause, "cause")).unionByName(tag(roots, "shared-roots"))


def packages_matching(packages: DataFrame, name: str, col: str = "pkg") -> DataFrame:
    """A package by its full name, or by its bare one in every architecture."""
    return packages.where((F.col(col) == name) | F.startswith(F.col(col), F.lit(name + ":")))


def runs_with_package(run_packages: DataFrame, packages: DataFrame, key: str = "run_key", col: str = "pkg") -> DataFrame:
    return run_packages.join(packages.select(col), col, "left_semi").select(key, "role").distinct()


def signature_buckets(runs: DataFrame, column: str, key: str = "run_key") -> DataFrame:
    """(column, key, n): the members of every bucket, a row each, with the bucket's size; no bucket is gathered in one row."""
    members = runs.where(F.col(column).isNotNull()).select(column, key)
    return members.join(members.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column)


def expand_names(bare: DataFrame, seen: DataFrame, name: str = "name", pkg: str = "pkg") -> DataFrame:
    """Bare names to every seen ``name:arch``; a name nobody saw stands for itself."""
    known = seen.select(pkg, F.split_part(F.col(pkg), F.lit(":"), F.lit(1)).alias("_bare")).distinct()
    return bare.join(known, bare[name] == known["_bare"], "left").select(*[bare[c] for c in bare.columns], F.coalesce(known[pkg], bare[name]).alias(pkg)).distinct()


def stale_first(ids: DataFrame, checks: DataFrame, key: str, checked: str, limit: int, among: list | None = None) -> DataFrame:
    """Never checked first, then longest ago.  ``among=[]`` asks for none, ``None`` for all."""
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct()
    if among is not None:
        ids = ids.where(F.col(key).isin(among))
    return ids.join(checks.select(key, checked), key, "left").orderBy(F.col(checked).asc_nulls_first(), key).limit(limit)


def refresh_targets(groups: list[DataFrame], key: str, checked: str, limit: int) -> DataFrame:
    """Groups in order, in each the longest unchecked first; an id counts in its first group."""
    union = None
    for k, g in enumerate(groups):
        part = g.select(key, checked, F.lit(k).alias("group_no"))
        union = part if union is None else union.unionByName(part)
    first = union.groupBy(key).agg(F.min_by(F.struct("group_no", checked), "group_no").alias("x")).select(key, "x.*")
    return first.orderBy("group_no", F.col(checked).asc_nulls_first(), key).limit(limit)


def rank_capped(rows: DataFrame, group: list[str], order: list[Column], limit: int, always: Column, parts: int = 16) -> DataFrame:
    """The first ``limit`` rows of each group by ``order`` with their rank, and beyond them those that must stay, at rank ``limit + 1``.

    A group is ranked in ``parts`` hashed parts first, so that a hot one is no single task; of each
    part only the first ``limit`` are ranked again.  Rows equal in every column without maps fall into one part.
    """
    plain = [F.col(f"`{f.name.replace('`', '``')}`") for f in rows.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    part = F.pmod(F.xxhash64(*plain), F.lit(parts))
    tagged = rows.withColumns({"_always": F.coalesce(always, F.lit(False)), "_part": part})
    tagged = tagged.withColumn("_near", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    near = tagged.where(F.col("_near") <= limit).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    first = near.where((F.col("rank") <= limit) | F.col("_always")).withColumn("rank", F.least("rank", F.lit(limit + 1)))
    beyond = tagged.where((F.col("_near") > limit) & F.col("_always")).withColumn("rank", F.lit(limit + 1))
    return first.unionByName(beyond).drop("_always", "_part", "_near")


def reachable(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst", most_depth: int | None = None) -> DataFrame:
    """(root, node, depth): what each start reaches, by joins over the unvisited frontier until it is empty.

    ``most_depth`` asks for what is that near only.

    The frontier is written out each round (see ``sources.scratch``), so the plan stays small and a
    lost executor costs one round at most.
    """
    from ..sources.scratch import materialize

    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("_next")).distinct()
    seen = materialize(starts.select(F.col(starts.columns[0]).alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in count(1) if most_depth is None else range(1, most_depth + 1):
        found = frontier.join(step, "node").select("root", F.col("_next").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = materialize(found.withColumn("depth", F.lit(depth)))
        if not frontier.head(1):
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = materialize(seen)  # the plan stays small on long chains too
    return seen


def duplicate_roots(links: DataFrame, key: str = "bug_id", to: str = "duplicate_of") -> DataFrame:
    """(key, root): the end of each chain of duplicates; a cycle, and what leads into it, ends at the cycle's least member.

    Pointer doubling: every round each row jumps as far again as it has come, so a chain of n links
    takes log2(n) rounds of one join over one row a key.  Of several links of a key the least counts.
    """
    from ..sources.scratch import discard, materialize

    links = links.where(F.col(key).isNotNull() & F.col(to).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(to).alias("at"))
    jumps = materialize(links.select("k", "at", F.least("k", "at").alias("low"), F.lit(True).alias("open")))
    for n in count(1):
        ahead = jumps.select(F.col("k").alias("at"), F.col("at").alias("further"), F.col("low").alias("more"))
        step = jumps.join(ahead, "at", "left")
        moved = materialize(step.select("k", F.coalesce("further", "at").alias("at"), F.least("low", "more").alias("low"), F.col("further").isNotNull().alias("open")))
        discard(jumps)
        jumps = moved
        left = jumps.where("open").count()
        # none is open, or all that are have come to their end or gone round their cycle: a row further from
        # its end would leave more than 2 ** (n - 1) open behind it
        if 2**n >= 2 * left:
            break
    cycles = jumps.select(F.col("k").alias("at"), F.col("low").alias("least"))
    found = jumps.join(cycles, "at", "left")
    return found.select(F.col("k").alias(key), F.when(F.col("open"), F.coalesce("least", "at")).otherwise(F.col("at")).alias("root"))
