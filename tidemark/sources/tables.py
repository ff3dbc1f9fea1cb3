"""The product's Parquet tables: named schemas, token partitions, token-exact swaps.

Every write names its last partition by a token and overwrites exactly the partitions it produces,
so writing a batch again replaces it. Rewriting what is already there names the token partitions it
read: the new rows are staged whole, written beside them, and only those partitions are removed. A
swap that was cut off is finished by running it again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.operators.page_tree import PageSets
from tidemark.schema import TABLES

# Smaller row groups than Parquet's default: files are sorted by (language, time), so a window of
# minutes skips most of a day, and one day's file still splits across tasks.
ROW_GROUP_BYTES = 16 * 1024 * 1024

_SORT = {
    "edits": ("lang", "event_time"),
    "edits_per_minute": ("lang", "minute"),
    "pages_per_minute": ("lang", "namespace", "title"),
    "pages_per_hour": ("lang", "namespace", "title"),
    "pages_per_day": ("lang", "namespace", "title"),
}


# A stream's token: the run, then the batch number (see streaming/ingest.py).
_BATCH = re.compile(r"(.+)-(\d{9})")
_NOTE = "part_value STRING, old_token STRING, new_token STRING"


@dataclass(frozen=True)
class Held:
    """Token partitions of one table, as (partition value, token); a log's have no value."""

    name: str
    tokens: tuple[tuple[str | None, str], ...]


class Files:
    """Directory listing and removal through the cluster's own file system."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def glob(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(str(s.getPath().toString()) for s in (fs.globStatus(p) or []))

    def children(self, path: str, prefix: str) -> list[str]:
        """Values of `prefix=value` directories right under `path`."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(n[len(prefix) + 1 :] for n in names if n.startswith(f"{prefix}="))

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Tables:
    """All tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        schema, _ = TABLES[name]
        if not self.files.exists(self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def page_sets(self) -> PageSets:
        """The page sets of minutes, hours and days."""
        return PageSets(self.read("pages_per_minute"), self.read("pages_per_hour"), self.read("pages_per_day"))

    def read_token(self, name: str, token: str) -> DataFrame:
        """The rows one write produced, listing only its own directories."""
        schema, partitions = TABLES[name]
        found = self.files.glob("/".join([self.path(name), *["*"] * (len(partitions) - 1), f"token={token}"]))
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*found)

    def write_once(self, name: str, rows: DataFrame, token: str) -> None:
        """Write rows under `token`; the same token again replaces the same rows. Edits get their summary right after."""
        self.put(name, rows, token)
        if name == "edits":
            self.summarize(self.read_token("edits", token), token)

    def put(self, name: str, rows: DataFrame, token: str | Column) -> None:
        """Write rows under `token` (a column gives rows tokens of their own), without a summary.

        Rows are rebalanced by partition, which also splits an oversized one across tasks.
        """
        schema, partitions = TABLES[name]
        rows = rows.withColumn("token", F.lit(token) if isinstance(token, str) else token).select(*schema.fieldNames())
        if len(partitions) > 1:
            rows = rows.hint("rebalance", partitions[0])
        if name in _SORT:
            # partition columns first: else the writer sorts by them and loses the order inside a file
            rows = rows.sortWithinPartitions(*partitions, *_SORT[name])
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("parquet.block.size", ROW_GROUP_BYTES)
            .partitionBy(*partitions)
            .parquet(self.path(name))
        )

    def summarize(self, edits: DataFrame, token: str) -> None:
        """Write the ledger rows of one token's edits."""
        self.write_once("edit_batches", ledger.summaries(edits), token)

    def ledger(self, days: Sequence[str] | None = None) -> DataFrame:
        """Summaries of the stored edits, of some days if given: only their folders are listed."""
        if days is None:
            return self.read("edit_batches")
        schema, _ = TABLES["edit_batches"]
        folders = [f for f in (f"{self.path('edit_batches')}/dt={day}" for day in days) if self.files.exists(f)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path("edit_batches")).parquet(*folders)

    def complete_ledger(self) -> int:
        """Summarize writes of edits that have no summary (cut off between the two, or older than the ledger)."""
        days = self.partitions("edits")
        known = set(self.hold("edit_batches", days).tokens)
        lacking = [t for t in self.hold("edits", days).tokens if t not in known]
        if lacking:
            rows = ledger.summaries(self.read_held(Held("edits", tuple(lacking))))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "token").parquet(self.path("edit_batches"))
        return len(lacking)

    def read_listed(self, name: str, writes: DataFrame) -> DataFrame:
        """The rows of the writes in a (dt, token) list, opening only their folders."""
        listed = writes.select(F.col("dt").cast("string"), "token").distinct().collect()
        return self.read_held(Held(name, tuple((r["dt"], r["token"]) for r in listed)))

    def stored_since(self, since_ms: int) -> DataFrame:
        """Edits of the writes that may hold rows stored after a time."""
        return self.read_listed("edits", ledger.stored_since(self.ledger(), since_ms))

    def batches(self) -> list[str]:
        """The newest batch of every stream: it may be replayed, as its commit can't be seen here."""
        newest: dict[str, str] = {}
        for _, token in self.hold("edits", self.partitions("edits")).tokens:
            if batch := _BATCH.fullmatch(token):
                newest[batch[1]] = max(token, newest.get(batch[1], ""))
        return sorted(newest.values())

    def fence(self, name: str, values: Sequence[str], token: str) -> None:
        """Note, before a rewrite of these partitions, the batches whose replay it would undo or double."""
        batches = self.batches()
        if batches:
            noted = [(name, str(value), batch) for value in values for batch in batches]
            self.write_once("fences", self.spark.createDataFrame(noted, "name STRING, part_value STRING, batch STRING"), f"{name}-{token}")

    def fenced(self, batch: str) -> dict[str, set[str]]:
        """The partitions of each table that were rewritten since a batch was first written."""
        if not self.files.exists(self.path("fences")):
            return {}
        found: dict[str, set[str]] = {}
        for row in self.read("fences").where(F.col("batch") == batch).select("name", "part_value").distinct().collect():
            found.setdefault(row["name"], set()).add(row["part_value"])
        return found

    def partitions(self, name: str) -> list[str]:
        """Values of the first partition column (days or months: bounded by retention)."""
        _, partitions = TABLES[name]
        return self.files.children(self.path(name), partitions[0])

    def _edge_ms(self, days: list[str], column: str) -> int | None:
        """A column of the extent of the first of `days` that has rows."""
        for day in days:
            found = ledger.extent(self.ledger([day])).first()[column]
            if found is not None:
                return found
        return None

    def watermark_ms(self) -> int | None:
        """Newest event time, from the newest day's summaries: neither raw rows nor older days are opened."""
        return self._edge_ms(self.partitions("edit_batches")[::-1], "newest_ms")

    def oldest_ms(self) -> int | None:
        """Oldest event time, from the oldest day's summaries."""
        return self._edge_ms(self.partitions("edit_batches"), "oldest_ms")

    def hold(self, name: str, values: Sequence[str] | None = None, settled: bool = False) -> Held:
        """The token partitions there are now, of the partitions `values` (all of a log's if none).

        `settled` leaves out the newest batch of every stream: it may not be committed yet, and its
        replay has to find its own token.
        """
        _, partitions = TABLES[name]
        if len(partitions) == 1:
            found = [(None, token) for token in self.files.children(self.path(name), "token")]
        else:
            folders = ((str(v), f"{self.path(name)}/{partitions[0]}={v}") for v in values)
            found = [(v, token) for v, folder in folders for token in self.files.children(folder, "token")]
        if settled:
            newest: dict[tuple, str] = {}
            for value, token in found:
                if batch := _BATCH.fullmatch(token):
                    newest[value, batch[1]] = max(token, newest.get((value, batch[1]), ""))
            found = [(v, t) for v, t in found if t not in {newest.get((v, b[1])) for b in [_BATCH.fullmatch(t)] if b}]
        return Held(name, tuple(found))

    def _folder(self, name: str, value: str | None, token: str) -> str:
        _, partitions = TABLES[name]
        return f"{self.path(name)}/token={token}" if value is None else f"{self.path(name)}/{partitions[0]}={value}/token={token}"

    def read_held(self, held: Held) -> DataFrame:
        """The rows of exactly the token partitions that `held` names."""
        schema, _ = TABLES[held.name]
        if not held.tokens:
            return self.spark.createDataFrame([], schema)
        folders = [self._folder(held.name, value, token) for value, token in held.tokens]
        return self.spark.read.schema(schema).option("basePath", self.path(held.name)).parquet(*folders)

    def swap(self, held: Held, rows: DataFrame, token: str) -> None:
        """Put `rows` in the place of what `held` names; anything written since stays as it is.

        What is to go is noted first, then the new rows are staged, then written beside the old ones under a
        token of their own, and last the noted tokens are removed. Each step can be done again, by
        `finish_replace`. A reader that lists files between the last two steps sees both.
        """
        name = held.name
        schema, _ = TABLES[name]
        if self.files.exists(f"{self._stage(name)}/_SUCCESS"):
            raise RuntimeError(f"an earlier swap of {name} isn't finished; finish_replace comes first")
        taken = {t for _, t in held.tokens}
        while token in taken:
            token += "-again"
        going = [(None, None, token), *[(value, old, None) for value, old in held.tokens]]
        note = self.spark.createDataFrame(going, _NOTE).coalesce(1)
        note.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self._stage(name) + "-note")
        rows = rows.withColumn("token", F.lit(token)).select(*schema.fieldNames())
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self._stage(name))
        self.finish_replace(name)

    def replace(self, name: str, values: Sequence[str], rows: DataFrame, token: str) -> None:
        """Make partitions hold `rows` in the place of what they hold now, while nothing else writes."""
        self.swap(self.hold(name, values), rows, token)

    def _stage(self, name: str) -> str:
        return f"{self.root}/_staged/{name}"

    def finish_replace(self, name: str) -> None:
        """Complete a swap whose rows are staged whole; one that was cut off earlier changed nothing."""
        stage = self._stage(name)
        if not self.files.exists(f"{stage}/_SUCCESS"):
            return
        schema, _ = TABLES[name]
        note = self.spark.read.schema(_NOTE).parquet(f"{stage}-note").collect()
        token = next(r["new_token"] for r in note if r["new_token"] is not None)
        self.write_once(name, self.spark.read.schema(schema).parquet(stage), token)
        for row in note:
            if row["old_token"] is not None:
                self._remove(name, row["part_value"], row["old_token"])
        self.files.remove(stage)

    def _remove(self, name: str, value: str | None, token: str) -> None:
        self.files.remove(self._folder(name, value, token))
        if name == "edits":
            self.files.remove(self._folder("edit_batches", value, token))

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Write an intermediate result beside the tables and read it back, cutting its lineage."""
        path = f"{self.root}/_work/{name}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop_kept(self, name: str) -> None:
        self.files.remove(f"{self.root}/_work/{name}")

    def drop_partition(self, name: str, value: str) -> None:
        _, partitions = TABLES[name]
        self.files.remove(f"{self.path(name)}/{partitions[0]}={value}")
        if name == "edits":
            self.files.remove(f"{self.path('edit_batches')}/{partitions[0]}={value}")
