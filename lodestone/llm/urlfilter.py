"""URL filters with redirect equivalence.

A rule (host, path) fits its host and all subdomains where the url's path starts
with the rule's; of the rules that fit, the longest wins.  Urls that redirect to one
another or name one another canonical are one resource: the pages' redirect and
canonical-link edges are joined into components by distributed connected components,
and a page without a rule of its own takes its component's decision: allow where any
member is explicitly allowed, else block where any is blocked, else allow.  A page's
own rule always stands.  DataFrame functions only.

Edges come from ``<link rel="canonical" href=...>`` and
``<meta http-equiv="refresh" content="...url=...">`` in a page's html (and from an
optional table of further redirects).  A url's node is its host and path with the
query, without scheme and fragment.  Targets may be pages or not.

Defined results.  A null url, or one without ``://``, has empty host and path, fits no
rule, has no node and is allowed.  Repeated rows keep their rows.  Null html has no
edges.  Relative targets are resolved against the page's url as RFC 3986 has it (relative paths, queries alone, dot
segments; a base element is not looked at) once character references for ``&`` are decoded; one of
another scheme than http and https without ``//`` (mailto:, javascript:) is no edge.  ``rel`` may hold further
words beside canonical.  Of two rules with one host and path, allow wins.  Pages of any length are searched whole.
An empty table gives an empty table.  Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    """Only A-Z are lower-cased."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """Null where there is nothing to join on."""
    n = F.concat(host(url), F.regexp_extract(_after(url), r"^[^/?#]*([^#]*)", 1))
    return F.when(n != "", n)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules given as (host, path, verdict), as a table."""
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, verdict string")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) of ``urls`` that a rule fits: the longest; allow before block.

    A url meets the rules of its host and of the domains above it by an equi-join, so the work doesn't
    grow with the number of rules.
    """
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = distinct.withColumn("rule_host", F.explode(F.array_distinct(domains))).join(rules, "rule_host").where(F.startswith("path", F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(name).alias("n"), (F.col("verdict") == "allow").alias("allow"), name.alias("rule"), "verdict"))
    return met.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def without_dots(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""
    last = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.split(F.substring(path, 2, 1 << 30), "/"), F.array().cast("array<string>"), step)
    slash = F.when((last == "/") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), slash)


def resolve(target: Column, url: Column) -> Column:
    """A link's absolute url on the page ``url``; null where it names no page."""
    base_path, tail = path(url), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    own = F.regexp_extract(target, r"^([^?#]*)", 1)
    root = F.concat(F.lit("http://"), host(url))  # a node has no scheme
    query = F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)", 1)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_extract(base_path, r"^(.*/)", 1))
    absolute = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*:(//.*)$", 1)
    at_host = F.when(target.startswith("//"), target).otherwise(absolute)
    return (
        F.when(at_host != "", F.concat(F.lit("http:"), at_host))  # as it stands, like the pages' own urls
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(host(url) == "", F.lit(None).cast("string"))
        .when(own == "", F.concat(root, base_path, F.when(tail.startswith("?"), tail).otherwise(F.concat(query, tail))))
        .otherwise(F.concat(root, without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))), tail))
    )


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (src, dst) between nodes from canonical links and refresh redirects."""
    html, url = F.col(html_col), F.col(url_col)
    tags = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*\brel\s*=\s*(?:[\"'][^\"'>]*\bcanonical\b|canonical\b)[^>]*>)"), F.lit(1)), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), F.lit(1)), lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    may = html.rlike(r"(?i)<(link|meta)\b[^>]*\b(canonical|refresh)\b")
    found = pages.where(may).select(url.alias("u"), F.explode(F.filter(tags, lambda t: t != "")).alias("t"))
    found = found.withColumn("t", F.regexp_replace("t", r"(?i)&(amp|#0*38|#x0*26);", "&"))
    return found.select(node(F.col("u")).alias("src"), node(resolve(F.col("t"), F.col("u"))).alias("dst")).where("src is not null and dst is not null and src <> dst")


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: id, host, path, rule (null without one), verdict.

    ``rules``: tuples, or a table as ``rule_table`` makes it.  ``redirects``: further (src, dst) urls.
    """
    url = F.col(url_col)
    table = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    base = pages.select(F.col(id_col), node(url).alias("node"), host(url).alias("host"), path(url).alias("path"))
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst")).where("src is not null and dst is not null and src <> dst"))
    edges = materialize(edges.distinct(), "url-edges")
    classes = materialize(connected_components(edges), "url-classes")
    # every member url is judged by its own host and path, whether it is a page or only a target
    member = F.concat(F.lit("x://"), F.col("node"))
    members = classes.select("node", "component", host(member).alias("host"), path(member).alias("path"))
    own = members.join(ruled(members, table), ["host", "path"]).select("component", "verdict")
    decided = own.groupBy("component").agg(F.min("verdict").alias("method"))  # 'allow' < 'block': allow takes precedence
    alias = classes.join(decided, "component").select("node", "method")
    told = base.join(ruled(base, table), ["host", "path"], "left").join(alias, "node", "left")
    return told.select(id_col, "host", "path", "rule", F.coalesce("verdict", "method", F.lit("allow")).alias("verdict"))
