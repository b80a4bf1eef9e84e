"""Logs that arrive in parts: the open record, the section and the phase of each run are kept from batch to batch.

Spark's ``transformWithState`` keyed by run.  A run's lines come in order, cut into batches anywhere; a line that was taken up before
is passed over, so a batch that is run again changes nothing.  Each batch gives the records that it opened or continued
(``seq`` counts a run's records); a later row of the same record replaces the earlier one (``fold_into`` keeps a table so).
State is one row a run: its last line, its counters, and the lines of its open record, which the logs' caps bound.
"""

from __future__ import annotations

import datetime as dt
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ordered
from ..sources.keyed import KeyedTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "last long, seq int, section int, phase int, line_no long, head string, first_head string, continuation array<string>"
ROWS = "run_key {kind}, seq int, section int, phase int, line_no long, head string, first_head string, continuation array<string>"
STAMP = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}),(\d{3})\s"


class Folding(StatefulProcessor):
    """Rows (run_key, line_no, line, opens, starts, marker) to the records that they open or continue."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, seq, section, phase, line_no, head, first_head, more = self.held.get() if self.held.exists() else (None, 0, 0, 0, None, None, None, [])
        more, out = list(more or []), []
        # sorted here: a batch's rows of a run come as they were shuffled
        lines = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        told = lambda: (*key, seq, section, phase, line_no, head, first_head, list(more))
        changed = False
        for n, line, opens, starts, marker in zip(*(lines[c].tolist() for c in ("line_no", "line", "opens", "starts", "marker")), strict=True):
            if last is not None and n <= last:
                continue
            last = n
            section += bool(starts)
            if opens:
                if changed:
                    out.append(told())
                seq, line_no, head, more = seq + 1, n, line, []
                phase = max(phase, int(marker or 0))
                if first_head is None and _stamped(line):
                    first_head = line
                changed = True
            elif seq:
                more.append(line)
                changed = True
        if changed:
            out.append(told())
        self.held.update((last, seq, section, phase, line_no, head, first_head, more))
        if out:
            yield pd.DataFrame(out, columns=["run_key", "seq", "section", "phase", "line_no", "head", "first_head", "continuation"])

    def close(self) -> None:
        pass


def _stamped(line: str) -> bool:
    """Whether a record's stamp is a time that there is."""
    m = re.match(STAMP, line)
    try:
        return bool(m and dt.datetime.fromisoformat(f"{m[1]} {m[2]}"))
    except ValueError:
        return False


def folded(lines: DataFrame, key: str = "run_key", order: str = "line_no", text: str = "line", starts: Column | None = None) -> DataFrame:
    """A stream of lines to the records that each batch opens or continues, with ``section`` (of ``starts``) and running ``phase``."""
    kind = dict(lines.dtypes)[key]
    message = F.regexp_extract(text, ordered.RECORD, 5)
    rows = lines.select(F.col(key).alias("run_key"), F.col(order).cast("long").alias("line_no"), F.col(text).alias("line"), F.coalesce(F.col(text).rlike(ordered.RECORD), F.lit(False)).alias("opens"), (F.lit(False) if starts is None else F.coalesce(starts, F.lit(False))).alias("starts"), F.coalesce(ordered.phase_of(message), F.lit(0)).alias("marker"))
    return rows.groupBy("run_key").transformWithStateInPandas(Folding(), ROWS.format(kind=kind), "Update", "none")


def fold_into(lines: DataFrame, table: KeyedTable, checkpoint: str, **options) -> None:
    """Take up all lines that a stream has by now; ``table`` is keyed by run_key with the columns of ``ROWS``."""
    spark = lines.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        table.update(batch, lambda old: old.join(batch.select("run_key", "seq"), ["run_key", "seq"], "left_anti").select(*table.empty.columns).unionByName(batch.select(*table.empty.columns)))

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # the query takes its settings when it starts
    try:
        query = folded(lines, **options).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def records(table: DataFrame) -> DataFrame:
    """The records with the fields that ``ordered.fold_records`` gives."""
    return ordered.record_fields(table, F.col("first_head"))


def fold_in_batches(spark, batches: list[DataFrame], key: str, order: str, text: str) -> DataFrame:
    """Records of lines that arrive in so many parts, each taken up on its own, in the shared scratch folder."""
    import uuid

    from ..sources import scratch

    base = f"{scratch.root(spark)}/folds/{uuid.uuid4().hex}"
    kinds = dict(batches[0].dtypes)
    table = KeyedTable(spark, f"{base}/records", "run_key", ROWS.format(kind=kinds[key]))
    for batch in batches:
        batch.select(key, order, text).write.mode("append").parquet(f"{base}/lines")
        lines = spark.readStream.schema(f"{key} {kinds[key]}, {order} {kinds[order]}, {text} {kinds[text]}").parquet(f"{base}/lines")
        fold_into(lines, table, f"{base}/checkpoint", key=key, order=order, text=text)
    return records(table.read())


cloudpickle.register_pickle_by_value(sys.modules[__name__])
