"""Small tables, such as rule catalogues, as immutable snapshots behind manifests: a change is there as a whole or not at all.

A change writes its rows as a new snapshot that nobody refers to yet, and then its manifest, which names the snapshot, the action and the codes that it changed: path/manifests/<number>.json, put in
place by one rename that fails where that number is taken. So a loss before the rename leaves the table as it was, the line for the audit can't be missing or left over, and of two
writers that start from the same version one wins and the other raises Conflict. Old versions stay until `vacuum`. (On local disks the rename's look for a taken number and the move are two
steps, so that there only writers of one process, or of different times, are told apart for sure; HDFS does both at once.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_AUDIT = "version long, parent long, action string, codes array<string>, snapshot string"


class Conflict(Exception):
    """Another writer has made the version in the meantime."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _placed(spark: SparkSession, path: str, version: int, told: dict) -> None:
    """Write a manifest beside its place and rename it into that."""
    target = _path(spark, path, "manifests", f"{version:010d}.json")
    draft = _path(spark, path, "drafts", f"{uuid.uuid4().hex}.json")
    files = _files(spark, target)
    files.mkdirs(target.getParent())
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(told, ensure_ascii=False).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    rename = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = none
    try:
        context.rename(draft, target, rename)
    except Py4JJavaError as e:
        files.delete(draft, False)
        if files.exists(target):
            raise Conflict(f"version {version} is another writer's") from e
        raise


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last version; 0 before the first."""
    folder = _path(spark, path, "manifests")
    files = _files(spark, folder)
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def history(spark: SparkSession, path: str) -> DataFrame:
    """version, parent, action, codes, snapshot: a row for each version."""
    if not latest(spark, path):
        return spark.createDataFrame([], _AUDIT)
    return spark.read.schema(_AUDIT).json(str(_path(spark, path, "manifests").toString()))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last one by default; ValueError for a version that isn't there."""
    version = latest(spark, path) if version is None else version
    found = history(spark, path).where(F.col("version") == version).select("snapshot").collect()
    if not found:
        raise ValueError(f"there is no version {version}")
    return spark.read.parquet(_path(spark, path, "data", found[0][0]).toString())


def commit(rows: DataFrame, path: str, expected: int, action: str, codes: list[str]) -> int:
    """Make rows the version after `expected` and return its number; Conflict if that number is taken by now."""
    spark = rows.sparkSession
    if latest(spark, path) != expected:
        raise Conflict(f"version {expected} is not the last one")
    snapshot = uuid.uuid4().hex
    rows.write.parquet(_path(spark, path, "data", snapshot).toString())
    _placed(spark, path, expected + 1, {"version": expected + 1, "parent": expected, "action": action, "codes": sorted(codes), "snapshot": snapshot})
    return expected + 1


def change(spark: SparkSession, path: str, action: str, changed: Callable[[DataFrame], DataFrame], key: str = "code", tries: int = 5) -> int:
    """Apply a change to the last version and commit it, again on the new one where another writer was first; the codes of the audit are those of rows that came, went or differ."""
    for left in reversed(range(tries)):
        version = latest(spark, path)
        before = read(spark, path, version)
        after = changed(before)
        codes = [r[0] for r in after.exceptAll(before).select(key).union(before.exceptAll(after).select(key)).distinct().collect()]
        try:
            return commit(after, path, version, action, codes)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def audit(spark: SparkSession, path: str) -> DataFrame:
    """version, line: what was done to which code, in order of versions and codes; a version that changed nothing has no line."""
    rows = history(spark, path).select("version", "action", F.explode("codes").alias("code"))
    return rows.select("version", F.concat(F.upper("action"), F.lit(" "), "code").alias("line")).orderBy("version", "line")


def vacuum(spark: SparkSession, path: str, keep: int) -> int:
    """Delete the snapshots and manifests of all but the last `keep` versions, and what failed changes have left; returns the snapshots that went. No writer may be at work."""
    known = history(spark, path)
    kept = {r.snapshot for r in known.orderBy(F.desc("version")).limit(keep).collect()}
    old = [r.version for r in known.orderBy(F.desc("version")).collect()][keep:]
    folder = _path(spark, path, "data")
    files = _files(spark, folder)
    for version in old:
        files.delete(_path(spark, path, "manifests", f"{version:010d}.json"), False)
    gone = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName() not in kept]
    for p in gone:
        files.delete(p, True)
    files.delete(_path(spark, path, "drafts"), True)
    return len(gone)
