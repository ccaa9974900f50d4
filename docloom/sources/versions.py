"""Versioned folders of tables: writers add a version by one commit file, readers see the newest committed one.

``path/<table>/<by>=…/version=…`` holds rows; ``path/commits/<n>.json`` lists what is live at version n. A writer writes
its rows first, below a name that no other writer uses, and then creates the commit file of the version after the one it
started from. The file system lets one writer create that file; another gets a VersionConflict and nothing of it shows.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Writers of one driver commit one after another, whatever the file system promises.
_COMMITS = threading.Lock()


class VersionConflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Change:
    """Rows for one table. Without ``values`` they are added; with them they take the place of the partitions
    ``by`` = one of ``values``, also where no row is left."""

    rows: DataFrame
    values: tuple | None = None


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _path(spark, path)
    return fs.exists(folder)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    fs, folder = _path(spark, f"{path}/commits")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName()[:1].isdigit())


def _live(spark: SparkSession, path: str, version: int) -> dict[str, list[list]]:
    if version == 0:
        return {}
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/commits/{version}.json").collect()))


def _create(spark: SparkSession, path: str, text: str) -> None:
    fs, file = _path(spark, path)
    with _COMMITS:
        if fs.exists(file):
            raise VersionConflict(f"{path} is there already")
        try:
            out = fs.create(file, False)
        except Exception as taken:
            raise VersionConflict(f"{path} was created by another writer") from taken
        out.write(bytearray(text.encode()))
        out.close()


class Writer:
    """One version being written on top of ``base`` (the newest, if not given): tables first, then the commit."""

    def __init__(self, spark: SparkSession, path: str, by: list[str] = (), base: int | None = None):
        self.spark, self.path, self.by = spark, path, list(by)
        self.base = max(versions(spark, path), default=0) if base is None else base
        self.name = f"{self.base + 1}-{uuid.uuid4().hex[:12]}"
        self.live = _live(spark, path, self.base)

    def write(self, table: str, change: Change) -> DataFrame:
        """Write a change's rows, in one job; returns them as they were written, so that more can be derived from them."""
        rows = change.rows.withColumn("version", F.lit(self.name))
        rows.write.mode("append").partitionBy(*self.by, "version").parquet(f"{self.path}/{table}")
        entries = self.live.get(table, [])
        if change.values is None:
            self.live[table] = [*entries, [None, self.name]]
        else:
            put = sorted({str(v) for v in change.values})
            self.live[table] = [e for e in entries if str(e[0]) not in put] + [[v, self.name] for v in put]
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{table}").where(F.col("version") == self.name).drop("version")

    def commit(self) -> int:
        """Make the version visible, or raise a VersionConflict; what then was written stays unlisted until ``vacuum``."""
        _create(self.spark, f"{self.path}/commits/{self.base + 1}.json", json.dumps(self.live))
        return self.base + 1


def commit(spark: SparkSession, path: str, changes: dict[str, Change], by: list[str] = (), base: int | None = None) -> int:
    """Write ``changes`` to their tables and commit them as one version, which is returned.

    Rows are partitioned by the columns ``by``, of which the first tells what Change.values replace.
    """
    writer = Writer(spark, path, by, base)
    for table, change in changes.items():
        writer.write(table, change)
    return writer.commit()


def _shown(entries: list[list], by: str | None) -> Column:
    """Whether a partition is live: its version alone, or with its value of ``by``."""
    whole = [v for value, v in entries if value is None]
    parts = [f"{value}/{v}" for value, v in entries if value is not None]
    shown = F.col("version").isin(whole)
    return shown | F.concat_ws("/", F.col(by).cast("string"), "version").isin(parts) if parts else shown


def read(spark: SparkSession, path: str, table: str, by: str | None = None, version: int | None = None) -> DataFrame:
    """The rows of ``table`` that are live at ``version``, by default the newest, with the column ``version`` that
    names each row's write. Which files are live is a filter on partitions, so others are not opened."""
    at = max(versions(spark, path), default=0) if version is None else version
    live = _live(spark, path, at).get(table)
    if live is None:
        raise ValueError(f"{path} has no table {table} at version {at}")
    return spark.read.parquet(f"{path}/{table}").where(_shown(live, by))


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows read from an appended table, each key's row of the newest write, with ``revision``, the version's number."""
    revision = F.split("version", "-")[0].cast("int")
    rest = [c for c in rows.columns if c not in (*key, "version")]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest, revision.alias("revision")), revision).alias("_newest"))
    return newest.select(*key, "_newest.*")


def save_templates(spark: SparkSession, path: str, templates: DataFrame, retries: int = 20) -> int:
    """Append ``templates(template_id, name, fields, deleted)`` as one version. Saves commute, so a conflict is tried again."""
    for _ in range(retries):
        try:
            return commit(spark, path, {"templates": Change(templates)})
        except VersionConflict:
            continue
    raise VersionConflict(f"{path}: another writer was first {retries} times")


def templates(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(template_id, name, fields, revision): the newest revision of each template that is not deleted."""
    return latest(read(spark, path, "templates", version=version), "template_id").where(~F.col("deleted")).drop("deleted")


def vacuum(spark: SparkSession, path: str, table: str, keep: int = 1) -> int:
    """Remove files of ``table`` that none of the last ``keep`` versions lists; returns how many folders went.

    Not while a writer is at work: what it has not committed yet goes too. Older versions can't be read afterwards.
    """
    fs, folder = _path(spark, f"{path}/{table}")
    wanted = {(v, n) for version in versions(spark, path)[-keep:] for v, n in _live(spark, path, version).get(table, [])}
    base, found = len(fs.makeQualified(folder).toString()), {}
    files = fs.listFiles(folder, True)
    while files.hasNext():
        at = files.next().getPath().getParent()
        if at.getName().startswith("version="):
            found[at.toString()[base:].strip("/")] = at
    gone = 0
    for name, at in found.items():
        parts = name.split("/")
        value, version = parts[0].partition("=")[2] if len(parts) > 1 else None, parts[-1].removeprefix("version=")
        if (value, version) not in wanted and (None, version) not in wanted:
            fs.delete(at, True)
            gone += 1
    return gone
