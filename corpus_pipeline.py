"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir), ``docs`` with the columns of ``documents``, and
returns a DataFrame; it is written as Parquet and read again as the next one's docs.

* ``toxicity`` drops the documents scored 0.5 or more.  Labels come from ``labels``; the
  unlabelled text is the stage's own input.
* ``near_duplicates`` keeps one row of each class of near-duplicates: five-word shingles whose SimHash
  fingerprints differ in at most 3 bits, or whose sets have Jaccard similarity >= 0.8.  The kept row has the
  smallest id, null last, then the smallest row key.
* ``secrets`` replaces every secret in the texts (and sets n_chars anew).
* ``mixing`` repeats or drops documents to meet the sources' token targets.
* ``encode`` gives the token ids and their digests.

Defined results, in every stage.  Columns beyond those of ``documents`` go through under any name and of any type (the last stage
returns its own).  Ids may be null or repeat: rows go by a key over all of their values, so two rows that
share an id are two documents, and rows equal in every column are copies of one.  Null and empty texts: scored by the
intercept; one class (the empty set of shingles), so one row stays; without secrets; of size 0, which stays once;
no tokens.  Texts are read whole, however long.  Ties go to the smallest id, then the smallest key.  An
empty table gives an empty table; without a confirmed toxic label nothing is toxic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import edited_copies, mixing, piece_bpe, secrets_ledger, toxicity
from lodestone.llm.common import discard, materialize, quoted, read, row_key
from lodestone.llm.queries import tokenizer_path


def whole(docs: DataFrame) -> Column:
    """The row as one struct, so that no column of it can clash with a stage's own."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels").join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    scored = docs.select(whole(docs), toxicity.score_column(model, F.col("text"), spark).alias("score"))
    return scored.where("score < 0.5").select("row.*")


def once(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row, and the columns of ``chosen``): the rows whose key is among ``chosen`` (key, ...; a row a key); equal rows count as one."""
    keyed = docs.select(whole(docs), row_key(docs).alias("key"))
    repeated = keyed.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("many"))
    marked = materialize(chosen.join(repeated, "key", "left"), "pipeline-chosen")
    rows = keyed.join(marked, "key")
    return rows.where("many is null").unionByName(rows.where("many").dropDuplicates(["key"])).drop("key", "many")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = edited_copies.classes(docs).groupBy("class").agg(F.min("least").alias("least")).select("least.key")
    return once(docs, kept).select("row.*")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = secrets_ledger.scan(docs)[1].where(F.size("found") > 0).select("blob", "found")
    rows = docs.select(whole(docs), secrets_ledger.blob_id(F.col("text")).alias("blob")).join(ledger, "blob", "left")
    clean = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(secrets_ledger.redact(F.col("row.text"), F.col("found")))
    length = F.when(F.col("found").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    told = rows.select("row", "found", clean.alias("text"))
    changed = {"text": F.col("text"), "n_chars": length}
    return told.select(*[changed.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = docs.select(row_key(docs).alias("key"), "text", "source")
    plan = mixing.mix(sized, id_col="key").groupBy("key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    return once(docs, plan).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(docs, piece_bpe.model_bytes(tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Training, fingerprints and encoding have no SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(docs: DataFrame, stage) -> DataFrame:
        following = materialize(stage[1](spark, docs, sf_dir), f"pipeline-{stage[0]}")
        discard(docs)  # the table of the stage before; documents themselves are none
        return following

    return reduce(step, STAGES, read(spark, sf_dir, "documents"))
