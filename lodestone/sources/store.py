"""The store of runs: keyed Parquet tables in one folder.

A table's rows are replaced by key (delete, then insert), so putting a run again changes
nothing; a write touches the partitions of its keys alone (see ``keyed``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from .keyed import KeyedTable

VERSION, PARTS = 1, 64
TABLES = {
    "runs": "run_key string, bug_id long, attempt int, is_primary boolean, source_dir string, from_series string, to_series string, arch string, problem_type string, terminal_phase int, evidence_complete boolean, reached_dpkg boolean, top_cause string, cascade_size int, fragile boolean, third_party boolean, current_title string, ingested_at timestamp, lex_lines long, lex_unmatched long, tool_version string, rules_digest string, root_graph string, cause_tuple string",
    "run_templates": "run_key string, template string",
    "run_packages": "run_key string, pkg string, role string",
    "clusters": "cluster string, run_key string, tier int, joined_tier int, member_count long, canonical string",
    "bug_state": "bug_id long, status string, duplicate_of long, is_duplicate boolean, assignee string, importance string, title string, checked_at timestamp",
    "attachments": "bug_id long, name string, etag string, path string, size long, fetched_at timestamp",
    "meta": "key string, value string",
}
KEYS = {"runs": "run_key", "run_templates": "run_key", "run_packages": "run_key", "clusters": "run_key", "bug_state": "bug_id", "attachments": "bug_id", "meta": "key"}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        held = self.meta("schema_version")
        if held is not None and int(held) > VERSION:
            raise ValueError(f"the store has schema {held}; this library knows {VERSION}")
        if held is None:
            self.put_meta("schema_version", str(VERSION))

    def _table(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/{name}", KEYS[name], TABLES[name], 1 if name == "meta" else PARTS)

    def table(self, name: str) -> DataFrame:
        """A table's rows; columns that an older version lacks are null."""
        return self._table(name).read()

    def write(self, name: str, rows: DataFrame) -> None:
        """The whole table anew."""
        self._table(name).replace(rows)

    def meta(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).first()
        return row["value"] if row else None

    def put_meta(self, key: str, value: str) -> None:
        row = self.spark.createDataFrame([(key, value)], TABLES["meta"])
        self._table("meta").update(row, lambda old: state.replace_rows(old, row, "key"))

    def advance(self, key: str, when: str) -> str:
        """Move a cursor forward (ISO text); it never goes back, and one that can't be read counts as none."""
        old = self.meta(key)
        new = max(old, when) if old and old[:4].isdigit() else when
        if new != old:
            self.put_meta(key, new)
        return new

    def put_runs(self, runs: DataFrame, templates: DataFrame | None = None, packages: DataFrame | None = None) -> None:
        self._table("runs").update(runs, lambda old: state.replace_rows(old, runs, "run_key", ("ingested_at",)))
        for name, rows in (("run_templates", templates), ("run_packages", packages)):
            if rows is not None:
                self._table(name).update(runs, lambda old, rows=rows: state.delete_rows(old, runs, "run_key").unionByName(rows.select(*old.columns).distinct()))

    def delete_runs(self, keys: DataFrame) -> None:
        for name in ("runs", "run_templates", "run_packages", "clusters"):
            self._table(name).update(keys, lambda old: state.delete_rows(old, keys, "run_key"))

    def replace_clusters(self, members: DataFrame) -> None:
        self.write("clusters", members.select(*[c.split()[0] for c in TABLES["clusters"].split(", ")]))

    def put_states(self, updates: DataFrame, order: list[str]) -> None:
        folded = state.fold_updates(updates, "bug_id", order)
        self._table("bug_state").update(folded, lambda old: state.merge(old, folded, "bug_id"))

    def touch_states(self, ids: DataFrame, when) -> None:
        self._table("bug_state").update(ids, lambda old: state.touch(old, ids, "bug_id", "checked_at", when))

    def known_bugs(self) -> DataFrame:
        return self.table("runs").where("bug_id is not null").select("bug_id").distinct()
