"""Log directories and attachments as rows.

``files`` lists the known log files below a root (others aren't opened; contents are read only by plans that
select them, which ``attempts`` by itself does not); ``lines`` reads, caps, decodes, cleans and parts them.  Files are read by Spark's binary source, so any store
that Spark reaches will do; a file is capped to its last bytes by kind before decoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: File names, keys of attachments, attachments that never matter, byte caps.
FILES = {"apt.log": "apt", "apt-term.log": "apt_term", "history.log": "history", "main.log": "main", "term.log": "term", "xorg_fixup.log": "xorg_fixup", "screenlog.0": "screenlog"}
KEYS = {"aptlog": "apt", "apttermlog": "apt_term", "apthistorylog": "history", "mainlog": "main", "termlog": "term", "xorgfixuplog": "xorg_fixup", "screenlog": "screenlog", "historylog": "history", "apthistory": "history", "xorgfixup": "xorg_fixup", "screenlog0": "screenlog"}
PREFIX = "varlogdistupgrade"
IRRELEVANT = ("currentdmesg", "dependencies", "journalerrors", "proccpuinfominimal", "proccpuinfo", "procenviron", "procmodules", "procinterrupts", "lsusb", "lspci", "lspcivnvn", "varlogdistupgradelspcitxt", "varlogdistupgradeaptclonesystemstate", "crashreports", "gsettingschanges", "xorglog", "xorglogold", "udevdb", "acpitables", "rfkill", "cpuinfo")
CAPS = {"screenlog": 512_000, "term": 2_000_000, "apt_term": 4_000_000, "apt": 16_000_000}
PROGRESS = ("Preparing to unpack", "Unpacking", "Setting up", "Processing triggers for", "Removing", "Selecting previously unselected package", "Purging configuration files for")


def _of(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, source, folder, stamp) of every known log below ``root``."""
    known = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(FILES) + "}")
    raw = known.load(root).select("path", "length", "content")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    return raw.withColumn("source", _of(FILES, name)).where("source is not null").withColumn("stamp", F.when(folder.rlike(r"^\d{8}-\d{4}$"), folder)).withColumn("folder", F.regexp_replace("path", r"(/\d{8}-\d{4})?/[^/]+$", ""))


def attempts(found: DataFrame) -> DataFrame:
    """Adds ``attempt`` (0 at the top, archived ones from 1, newest first), ``is_primary`` and ``run_key``."""
    seen = found.select("folder", "stamp").distinct()
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(F.col("stamp").isNull().cast("int"), F.desc("stamp")))
    numbered = seen.withColumn("attempt", F.when(F.col("stamp").isNull(), 0).otherwise(rank))
    numbered = numbered.withColumn("is_primary", F.col("attempt") == F.min("attempt").over(Window.partitionBy("folder")))
    key = F.concat(F.lit("dir:"), F.col("folder"), F.lit("#"), F.col("attempt").cast("string"))
    joined = found.alias("f").join(numbered.alias("n"), (F.col("f.folder") == F.col("n.folder")) & F.col("f.stamp").eqNullSafe(F.col("n.stamp")))
    return joined.select("f.*", "n.attempt", "n.is_primary").withColumn("run_key", key)


def capped(content: Column, source: Column) -> Column:
    """The last bytes of a file over its cap, from the first whole line on."""
    cap = F.coalesce(_of(CAPS, source), F.lit(1 << 30))
    tail = F.substring(content, -cap, cap)
    text = F.decode(F.when(F.octet_length(content) > cap, tail).otherwise(content), "UTF-8")
    return F.when(F.octet_length(content) > cap, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(text)


def lines(found: DataFrame, redacted: bool = True, key: str = "run_key") -> DataFrame:
    """(run_key, source, line_no, line) of cleaned lines, numbered from 1; an empty file has one empty line."""
    text = capped(F.col("content"), F.col("source"))
    rows = found.select(key, "source", F.posexplode(T.clean_lines(text, redacted)).alias("n", "line"))
    return rows.select(key, "source", (F.col("n") + 1).alias("line_no"), "line")


def attachments(rows: DataFrame) -> DataFrame:
    """(bug_id, title, text) to attempts of bugs: source by title, else by content; the irrelevant left out."""
    kept = rows.where(~is_irrelevant(F.col("title")))
    source = F.coalesce(source_of_title(F.col("title")), sniff(F.col("text")))
    out = kept.withColumn("source", source).where("source is not null")
    return out.select("bug_id", F.concat(F.lit("lp:"), F.col("bug_id").cast("string"), F.lit("#0")).alias("run_key"), "source", F.encode("text", "UTF-8").alias("content"), F.lit(0).alias("attempt"), F.lit(True).alias("is_primary"))


def normal_title(title: Column) -> Column:
    out = F.lower(F.trim(title))
    for _ in range(4):
        out = F.regexp_replace(out, r"(\.log\.txt|\.txt|\.gz|\.tar)$", "")
    return F.regexp_replace(out, r"[-_ ]", "")


def source_of_title(title: Column) -> Column:
    plain = _of(FILES, F.lower(F.trim(title)))
    bare = normal_title(title)
    return F.coalesce(plain, F.when(bare.startswith(PREFIX), _of(KEYS, F.regexp_replace(F.substring(bare, len(PREFIX) + 1, 1000), r"\.", ""))))


def is_irrelevant(title: Column) -> Column:
    return normal_title(title).isin(*IRRELEVANT) | F.lower(title).rlike(r"\.(png|jpe?g|gif|bmp|webp|svg|pdf)$")


def sniff(text: Column, limit: int = 64_000) -> Column:
    """What a log is by its opening."""
    head = F.substring(text, 1, limit)
    # fixed values: the openings of each kind of log
    return (
        F.when(head.rlike(r"(?m)^Log time: (\w{3} \w{3}|\d{4}-)"), "apt")
        .when(head.rlike(r"(?m)^(?:  )*(?:Investigating|Broken|Considering) \S+ "), "apt")
        .when(head.rlike(r"(?m)^Start-Date: \d{4}-\d{2}-\d{2}"), "history")
        .when(head.rlike(r"(?m)^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} (?:DEBUG|INFO|WARNING|ERROR|CRITICAL) "), "main")
        .when(head.rlike(r"(?m)^(?:" + "|".join(PROGRESS) + r") .*\.\.\."), "apt_term")
        .when(head.rlike(r"(?m)^dpkg: (?:error|warning)"), "apt_term")
    )


FIELD = r"^([A-Za-z][A-Za-z0-9._-]*):(?: (.*))?$"


def report_fields(bugs: DataFrame, key: str = "bug_id", text: str = "description") -> DataFrame:
    """(bug_id, preamble, fields): ``Key: value`` lines with continuations indented by one space; blank lines end nothing."""
    rows = bugs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    opens = F.col("line").rlike(FIELD) & ~F.col("line").rlike(r"^[ \t]")
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("g", F.sum(opens.cast("int")).over(w))
    before = rows.where("g = 0").groupBy(key).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n")).alias("preamble"))
    more = F.col("line").rlike(r"^[ \t]")
    body = rows.where(F.col("g") > 0).groupBy(key, "g").agg(
        F.max(F.when(opens, F.regexp_extract("line", FIELD, 1))).alias("k"),
        F.max(F.when(opens, F.regexp_extract("line", FIELD, 2))).alias("v"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(more, F.struct("n", "line")))), lambda r: F.regexp_replace(r["line"], r"^( |\t+)", "")), "\n").alias("rest"),
    )
    value = F.regexp_replace(F.concat_ws("\n", F.nullif(F.col("v"), F.lit("")), F.nullif(F.col("rest"), F.lit(""))), r"^\n+|\n+$", "")
    last = body.groupBy(key, "k").agg(F.max_by(value, "g").alias("v"))
    fields = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))
    return bugs.select(key).distinct().join(before, key, "left").join(fields, key, "left")


def report_facts(fields: Column) -> list[Column]:
    """Columns drawn from a report's fields."""
    get = lambda k: F.trim(F.coalesce(fields[k], F.lit("")))
    kernel = F.regexp_extract(get("Uname"), r"^Linux (\S+)", 1)
    release = F.coalesce(F.nullif(F.regexp_extract(get("DistroRelease"), r"(\d+\.\d+)", 1), F.lit("")), get("DistroRelease"))
    media = F.regexp_extract(get("InstallationMedia"), r"(\d{2}\.\d{2})", 1)
    empty = F.filter(F.map_keys(F.coalesce(fields, F.create_map().cast("map<string,string>"))), lambda k: source_of_title(k).isNotNull() & (F.trim(fields[k]) == ""))
    signature = F.when(F.array_contains(F.map_keys(F.coalesce(fields, F.create_map().cast("map<string,string>"))), "ProcVersionSignature"), ~get("ProcVersionSignature").startswith("Ubuntu"))
    return [
        get("ProblemType").alias("problem_type"), F.regexp_extract(get("Package"), r"^(\S+)", 1).alias("package"), release.alias("distro_release"), get("Architecture").alias("architecture"), kernel.alias("kernel_release"), get("Traceback").alias("traceback"), get("DuplicateSignature").alias("duplicate_signature"),
        F.coalesce(signature, (kernel != "") & ~kernel.rlike(r"^\d+\.\d+\.\d+-\d+-(generic|lowlatency|aws|azure|gcp|oem|raspi|kvm|oracle|ibm|nvidia|realtime)")).alias("third_party_kernel"),
        ((media != "") & (release != "") & (media != release)).alias("chained_upgrade"), (~F.lower(get("CasperMD5CheckResult")).isin("", "pass", "skip")).alias("media_check_failed"), (get("ProblemType") == "Crash").alias("is_crash"), empty.alias("empty_logs"), F.exists(empty, lambda k: source_of_title(k) == "apt_term").alias("dpkg_silent"),
    ]


SERIES = "version string, codename string, series string, created date, release date, eol date, eol_esm date"


def series_table(spark: SparkSession, path: str) -> DataFrame:
    """The release dimension from its CSV; a missing file gives an empty one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SERIES)
    raw = spark.read.option("header", True).csv(path)
    col = lambda *names: next((F.col(f"`{n}`") for n in names if n in raw.columns), F.lit(None))
    return raw.select(F.regexp_extract(col("version"), r"^(\d+\.\d+)", 1).alias("version"), col("codename").alias("codename"), col("series").alias("series"), *[col(n.replace("_", "-"), n).cast("date").alias(n) for n in ("created", "release", "eol", "eol_esm")])


def release_number(version: Column) -> Column:
    return F.struct(F.split_part(version, F.lit("."), F.lit(1)).try_cast("int").alias("y"), F.split_part(version, F.lit("."), F.lit(2)).try_cast("int").alias("m"))


def upgrade_steps(pairs: DataFrame, series: DataFrame) -> DataFrame:
    """Adds is_upgrade, is_lts_to_lts and steps (releases in between) to (from_series, to_series)."""
    s = series.select("series", release_number(F.col("version")).alias("no"), (F.col("version").rlike(r"\.04$") & (F.split_part("version", F.lit("."), F.lit(1)).try_cast("int") % 2 == 0)).alias("lts"))
    a, b = (s.select(F.col("series").alias(f"{x}_series"), F.col("no").alias(x[0]), F.col("lts").alias(f"{x[0]}l")) for x in ("from", "to"))
    # the whole dimension, some dozens of releases, beside each distinct pair
    all_ = s.agg(F.collect_list(F.struct("series", "no")).alias("all"), F.lit(1).alias("one"))
    j = pairs.select("from_series", "to_series").distinct().join(a, "from_series", "left").join(b, "to_series", "left").withColumn("one", F.lit(1)).join(all_, "one")
    between = F.filter("all", lambda x: (x["no"] > F.col("f")) & (x["no"] < F.col("t")))
    out = j.withColumn("steps", F.coalesce(F.sort_array(F.array_distinct(F.transform(between, lambda x: x["series"]))), F.array().cast("array<string>")))
    up = F.coalesce(F.col("t") > F.col("f"), F.lit(False))
    return out.select("from_series", "to_series", up.alias("is_upgrade"), (up & F.coalesce(F.col("fl") & F.col("tl"), F.lit(False))).alias("is_lts_to_lts"), "steps")
