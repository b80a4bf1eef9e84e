"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  The ledger
holds one row per (blob, rule version) already scanned, with its findings.  A scan
    1. reduces the versions to distinct blobs (pre-aggregated before the shuffle),
    2. drops the (blob, rule version) pairs that the ledger has,
    3. runs the rules over the rest, once per blob, and adds them to the ledger,
    4. joins the findings back to every path that has the blob.
All of it is DataFrame functions; nothing runs in Python.

Positions.  ``regexp_extract_all`` gives matches without places, and ``split`` by the same pattern
what lies between them: the lengths of gaps and matches, summed up along a blob, are the places, in
code points.  The sums are a window over rows, so a text of very many secrets costs no more for each.
A text is only taken apart where a cheaper test finds that the rule may hit.

Defined results.  Null text is the empty blob.  Empty texts have no spans.  Repeated
rows keep their rows.  An empty table gives an empty result.  Texts are scanned whole, however long.  Other columns
are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Kind, pattern, group that has a least length (0: the match), that length, and a cheap test.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    ("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)


def rule_version(rules=RULES) -> str:
    """Names a set of rules by its content: a changed rule makes every blob unseen."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


SPAN = "struct<start:int,end:int,kind:string,after:int>"


def matches(text: Column, kind: str, order: int, pattern: str, group: int, test: str) -> Column:
    """array<struct<order, kind, i, gap, hit, value>>: lengths of each match, of its valued group, and of what lies before it."""
    gaps = F.split(text, pattern)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    told = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(0))).alias("g"), hits.alias("h"), value.alias("v")),
        lambda z, i: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["h"]).alias("hit"), F.length(z["v"]).alias("value")),
    )
    return F.when(text.rlike(test), told).otherwise(F.array().cast("array<struct<order:int,kind:string,i:int,gap:int,hit:int,value:int>>"))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text) to (blob, rule_version, found): ``found`` by start, then in the rules' order; ``after``: where all spans before end.

    Matches become rows, and a running sum over a blob's matches of one kind gives their places; only
    lengths are shuffled, and only of blobs that have a match.
    """
    each = F.concat(*[matches(F.col("text"), kind, k, pattern, group, test) for k, (kind, pattern, group, _, test) in enumerate(rules)])
    told = materialize(blobs.select("blob", each.alias("m")), "ledger-matches")
    least = F.create_map(*[x for r in rules for x in (F.lit(r[0]), F.lit(r[3]))])
    so_far = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = told.select("blob", F.explode("m").alias("m")).select("blob", "m.*").repartition("blob").withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far).cast("int"))
    kept = rows.where(F.col("value") >= least[F.col("kind")]).select("blob", (F.col("end") - F.col("hit")).alias("start"), "order", "end", "kind")
    before = Window.partitionBy("blob").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.select("blob", F.struct("start", "order", "end", "kind", F.coalesce(F.max("end").over(before), F.lit(0)).alias("after")).alias("s"))
    listed = kept.groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias("s"))
    found = F.transform("s", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind", "after")]))
    return told.select("blob").join(listed, "blob", "left").select("blob", F.lit(rule_version(rules)).alias("rule_version"), F.coalesce(found, F.array().cast(f"array<{SPAN}>")).alias("found"))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def extend_ledger(versions: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text", rules=RULES) -> DataFrame:
    """Rows to add to the ledger: the findings of the blobs in ``versions`` that it lacks for these rules."""
    blobs = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version(rules)).select("blob").distinct()
        blobs = blobs.join(known, "blob", "left_anti")
    return scan_blobs(blobs.groupBy("blob").agg(F.first("text").alias("text")), rules)


def scan(versions: DataFrame, ledger: DataFrame | None = None, *, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what is unseen; returns (findings of every path, the ledger as it now stands)."""
    added = materialize(extend_ledger(versions, ledger, text_col=text_col, rules=rules), "ledger")
    whole = added if ledger is None else ledger.select(*added.columns).unionByName(added)
    current = whole.where(F.col("rule_version") == rule_version(rules)).groupBy("blob").agg(F.first("found").alias("found")) if ledger is not None else added
    paths = versions.select(*path_cols, blob_id(F.col(text_col)).alias("blob"))
    return paths.join(current.select("blob", "found"), "blob").select(*path_cols, "blob", "found"), whole


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def scan_commits(commits: list[DataFrame], **options) -> tuple[DataFrame, DataFrame]:
    """``scan`` of one batch of versions after another, each against the ledger of those before it."""
    ledger, found = None, None
    for versions in commits:
        told, ledger = scan(versions, ledger, **options)
        found = told if found is None else found.unionByName(told)
    return found, ledger


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span (overlapping ones merged) replaced by ``mark``; spans come by start."""
    apart = F.filter(found, lambda s: s["start"] >= s["after"])  # the others overlap what is hidden already
    shown = F.transform(apart, lambda s: F.concat(F.substring(text, s["after"] + 1, s["start"] - s["after"]), F.lit(mark)))
    tail = F.substring(text, F.array_max(F.transform(found, lambda s: s["end"])) + 1, F.length(text))
    return F.when(text.isNull() | (F.size(found) == 0), text).otherwise(F.concat(F.array_join(shown, ""), tail))
