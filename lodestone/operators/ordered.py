"""Operators on ordered streams, as window plans partitioned by run.

A run's rows are one window partition (logs are capped at megabytes a run); nothing is
ever sorted globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHASES = {"UNKNOWN": 0, "INIT": 10, "SCREEN_REEXEC": 15, "PRE_CACHE_OPEN": 20, "CACHE_OPEN": 25, "VIEW_DEPENDS": 30, "INITIAL_UPDATE": 35, "POST_INITIAL_UPDATE": 40, "SOURCES_REWRITE": 45, "SECOND_UPDATE": 50, "PRE_DIST_UPGRADE": 55, "CALCULATE": 60, "FETCH": 65, "COMMIT": 70, "POST_UPGRADE": 75, "REMOVE_OBSOLETE": 80, "POST_CLEANUP": 85, "POST_INSTALL_SCRIPTS": 90, "DONE": 100}

#: Openings of messages, by the phase they mark.  First match wins.
PHASE_MARKERS = (
    ("INIT", ("Using config files ", "uname information:", "release-upgrader version ")),
    ("INIT", (r"~Using '\S+' view",)),
    ("SCREEN_REEXEC", ("re-exec inside screen:", "screen returned:")),
    ("PRE_CACHE_OPEN", ("_pythonSymlinkCheck run", "running Quirks.PreCacheOpen")),
    ("CACHE_OPEN", ("openCache()", "/openCache(), new cache size", "need_server_mode()")),
    ("VIEW_DEPENDS", ("checkViewDepends()",)),
    ("INITIAL_UPDATE", ("running doUpdate() (showErrors=False)",)),
    ("POST_INITIAL_UPDATE", ("doPostInitialUpdate", "running Quirks.PostInitialUpdate")),
    ("SOURCES_REWRITE", ("updateDeb822Sources()", "migrateToDeb822Sources()", "updateSourcesList()", "verifySourcesListEntry:")),
    ("SECOND_UPDATE", ("running doUpdate() (showErrors=True)",)),
    ("PRE_DIST_UPGRADE", ("running Quirks.PreDistUpgradeCache", "Running KeepInstalledSection rules")),
    ("CALCULATE", (r"~Marking '\S+' for upgrade", "running Quirks.PostDistUpgradeCache", "running installTasks", "About to apply the following changes")),
    ("FETCH", ("Fetch: updateStatus",)),
    ("COMMIT", ("running Quirks.StartUpgrade", "writing dpkg progress log to", "got a conffile-prompt from dpkg", "cache.commit() returned")),
    ("POST_UPGRADE", ("running Quirks.PostUpgrade",)),
    ("REMOVE_OBSOLETE", ("Start checking for obsolete pkgs", "tryMarkObsoleteForRemoval()", "Finish checking for obsolete pkgs")),
    ("POST_CLEANUP", ("running Quirks.PostCleanup",)),
    ("POST_INSTALL_SCRIPTS", ("Running PostInstallScript:",)),
    ("DONE", ("confirmRestart() called",)),
)

RECORD = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}),(\d{3})\s+(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s(.*)$"


def _so_far(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def group_number(df: DataFrame, starts: Column, key: list[str], order: list[str], name: str) -> DataFrame:
    """Number the groups that begin at rows where ``starts`` holds; rows before the first are group 0."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(_so_far(key, order)))


def fold_records(lines: DataFrame, key: list[str] = ["run_key"], order: str = "line_no", text: str = "line", calendar: bool = True) -> DataFrame:  # noqa: B006
    """Physical lines to records: what follows a stamped line continues it; lines before the first are dropped.

    ``t_ms`` counts from the run's first record, never below 0.  ``calendar=False`` takes the
    day of the month for the day, so that a log over the end of a month starts again at 0.
    """
    numbered = group_number(lines, F.col(text).rlike(RECORD), key, [order], "_rec").where("_rec > 0")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(text).alias("x"))))
    folded = numbered.groupBy(*key, "_rec").agg(rows.alias("_rows"))
    rows = folded.select(*key, F.col("_rec").cast("int").alias("seq"), F.col("_rows")[0]["n"].alias("line_no"), F.col("_rows")[0]["x"].alias("head"), F.transform(F.slice("_rows", 2, 1 << 30), lambda r: r["x"]).alias("continuation"))
    out = _stamped(rows)
    first = F.first(_millis("ts", calendar), ignorenulls=True).over(Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return _since(out, first, calendar).drop("head")


def _stamped(rows: DataFrame) -> DataFrame:
    """``rows`` with level, message and ts of the line that opens a record (``head``)."""
    get = lambda i: F.regexp_extract("head", RECORD, i)
    told = rows.withColumns({"level": F.when(get(4) == "CRITICAL", "ERROR").otherwise(get(4)), "message": get(5)})
    return told.withColumn("ts", _stamp(F.col("head")))


def _stamp(head: Column) -> Column:
    get = lambda i: F.regexp_extract(head, RECORD, i)
    return F.concat(get(1), F.lit(" "), get(2), F.lit("."), get(3)).try_cast("timestamp_ntz")


def _millis(ts: str, calendar: bool) -> Column:
    return F.expr(f"unix_millis(CAST({ts} AS timestamp))") if calendar else F.expr(f"((day({ts}) * 24 + hour({ts})) * 60 + minute({ts})) * 60000L + CAST(extract(SECOND FROM {ts}) * 1000 AS BIGINT)")


def _since(rows: DataFrame, first: Column, calendar: bool) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rows.withColumn("t_ms", F.greatest(zero, F.coalesce(_millis("ts", calendar) - first, zero)))


def record_fields(rows: DataFrame, first_head: Column, calendar: bool = True) -> DataFrame:
    """Records given as (head, continuation, ...) and the opening line of their run's first record with a time: level, message, ts, t_ms."""
    out = _stamped(rows).withColumn("_first", _stamp(first_head))
    return _since(out, _millis("_first", calendar), calendar).drop("_first", "head", "first_head")


def phase_of(message: Column) -> Column:
    """Code of the phase that a message marks, or null."""
    out = F.lit(None).cast("int")
    for phase, openings in reversed(PHASE_MARKERS):
        for o in reversed(openings):
            out = F.when(message.rlike("^" + o[1:]) if o.startswith("~") else message.startswith(o), PHASES[phase]).otherwise(out)
    return out


def running_phase(records: DataFrame, marker: Column, key: list[str], order: list[str], name: str = "phase") -> DataFrame:
    """The phase in effect after each row: phases never go back, so it is the running maximum."""
    return records.withColumn(name, F.max(F.coalesce(marker, F.lit(0))).over(_so_far(key, order)))


def phase_spans(records: DataFrame, key: list[str] = ["run_key"], failed: Column | None = None) -> DataFrame:  # noqa: B006
    """(key, phase, start_ms, end_ms, outcome): each phase entered, until the run's last record."""
    last = records.groupBy(*key).agg(F.max("t_ms").alias("end_ms"), F.max("phase").alias("_top"))
    spans = records.where("phase > 0").groupBy(*key, "phase").agg(F.min("t_ms").alias("start_ms")).join(last, key)
    end = F.when(F.col("phase") == F.col("_top"), F.when(failed if failed is not None else F.lit(False), "failed").otherwise("unknown")).otherwise("ok")
    return spans.select(*key, "phase", "start_ms", "end_ms", end.alias("outcome"))


def sections(tokens: DataFrame, starts: Column, key: list[str], order: list[str], conflict: Column, decision: Column, broken: Column, done: Column, content: Column, keeps: Column | None = None) -> DataFrame:
    """Sections between headers, empty ones dropped, repeats collapsed to the first and renumbered.

    The primary one has the greatest (broken, conflicts, decisions, not completed, index).
    """
    numbered = group_number(tokens, starts, key, order, "_sec")
    seen = numbered.groupBy(*key, "_sec").agg(
        F.coalesce(F.max(broken), F.lit(0)).alias("broken_count"),
        F.count_if(conflict).alias("conflicts"),
        F.count_if(decision).alias("decisions"),
        F.max(F.coalesce(done, F.lit(False))).alias("completed"),
        F.coalesce(F.max(keeps), F.lit(False)).alias("resolve_by_keep") if keeps is not None else F.lit(False).alias("resolve_by_keep"),
        F.count_if(broken.isNotNull()).alias("passes"),
        F.count_if(~starts).alias("_rows"),
        F.array_sort(F.collect_list(F.when(~starts, F.struct(*[F.col(o) for o in order], content.alias("_c"))))).alias("_all"),
    ).where("_rows > 0")
    seen = seen.withColumn("content_hash", F.sha2(F.array_join(F.transform("_all", lambda r: r["_c"]), "\n"), 256)).drop("_all")
    first = F.row_number().over(Window.partitionBy(*key, "content_hash").orderBy("_sec"))
    kept = seen.withColumn("_first", first).where("_first = 1")
    kept = kept.withColumn("section_idx", F.row_number().over(Window.partitionBy(*key).orderBy("_sec")) - 1)
    score = F.struct("broken_count", "conflicts", "decisions", (~F.col("completed")).alias("open"), "section_idx")
    best = F.max(score).over(Window.partitionBy(*key))
    return kept.withColumn("is_primary", score == best).withColumn("truncated", (F.col("passes") > 0) & ~F.col("completed")).drop("_first", "_rows")


def oscillations(tokens: DataFrame, key: list[str], subject: str, order: str, keep: Column, upgrade: Column, other: str, least: int = 5, terminal: float = 0.8) -> DataFrame:
    """Subjects kept back and upgraded over and over: reversals = the fewer of the two, both at least ``least``."""
    last = tokens.groupBy(*key).agg(F.max(order).alias("_end"))
    per = tokens.groupBy(*key, subject).agg(
        F.count_if(keep).alias("keeps"),
        F.count_if(upgrade).alias("upgrades"),
        F.min_by(F.when(keep & (F.col(other) != ""), F.col(other)), F.when(keep & (F.col(other) != ""), F.col(order))).alias("blocked_by"),
        F.min_by(F.when(upgrade & (F.col(other) != ""), F.col(other)), F.when(upgrade & (F.col(other) != ""), F.col(order))).alias("forced_by"),
        F.max(F.when(keep | upgrade, F.col(order))).alias("last_at"),
    )
    found = per.where((F.col("keeps") >= least) & (F.col("upgrades") >= least)).join(last, key)
    return found.select(*key, subject, "keeps", "upgrades", F.least("keeps", "upgrades").alias("reversals"), "blocked_by", "forced_by", "last_at", (F.col("last_at") / F.col("_end") >= terminal).alias("is_terminal"))


def attach_scores(tokens: DataFrame, key: list[str], order: list[str], considering: Column, decision: Column, a: str, b: str, score_a: str, score_b: str, others: Column | None = None) -> DataFrame:
    """Scores from a weighing line go to the next decision if it names the same two; either way they are used up.

    Rows of ``others`` stay among the decisions, without scores and without using any up.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    weighs = considering | decision
    said = F.struct(considering.alias("is"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(score_a).alias("sa"), F.col(score_b).alias("sb"))
    if others is None:
        lagged = tokens.where(weighs).withColumn("_p", F.lag(said).over(w))
    else:
        lagged = tokens.where(weighs | others).withColumn("_p", F.last(F.when(weighs, said), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    same = F.col("_p.is") & (F.array_sort(F.array("_p.a", "_p.b")) == F.array_sort(F.array(a, b)))
    swap = F.col("_p.a") != F.col(a)
    done = lagged.where(decision if others is None else decision | others).withColumn("has_scores", F.coalesce(decision & same, F.lit(False)))
    return done.withColumn("score_first", F.when(F.col("has_scores"), F.when(swap, F.col("_p.sb")).otherwise(F.col("_p.sa")))).withColumn("score_second", F.when(F.col("has_scores"), F.when(swap, F.col("_p.sa")).otherwise(F.col("_p.sb")))).drop("_p")


def within(rows: DataFrame, spans: DataFrame, key: list[str], at: Column, start: str, end: str, slack_s: int) -> DataFrame:
    """Rows inside their run's span widened by ``slack_s`` seconds; a span without a start keeps all."""
    joined = rows.join(spans, key)
    edge = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {slack_s})")
    return joined.where(F.col(start).isNull() | ((at >= F.col(start) - edge) & (at <= F.coalesce(F.col(end), F.col(start)) + edge)))


def coherent(first_stamps: DataFrame, main: DataFrame, key: list[str] = ["run_key"], slack_s: int = 900) -> DataFrame:  # noqa: B006
    """(key, source, coherent): sources whose first stamp lies outside the main log's window are stale.

    A truncated main log, or one without a start, judges nothing.
    """
    j = first_stamps.join(main, key)
    edge = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {slack_s})")
    inside = (F.col("first_at") >= F.col("started_at") - edge) & (F.col("first_at") <= F.coalesce("ended_at", "started_at") + edge)
    return j.select(*key, "source", F.coalesce(F.col("truncated") | F.col("started_at").isNull() | F.col("first_at").isNull() | inside, F.lit(True)).alias("coherent"))


def collapse_repeats(rows: DataFrame, same: list[str], longest: Column, order: Column) -> DataFrame:
    """Of rows equal in ``same``, the longest; the earliest of those."""
    rank = F.row_number().over(Window.partitionBy(*same).orderBy(longest.desc_nulls_last(), order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")
