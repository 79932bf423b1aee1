"""Where results go: an append log, report texts, CSV, JSON and the rewritten catalogue with its backup and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.operators import catalogue as C


def append_log(results: DataFrame, path: str, at: str | None = None) -> None:
    """Append a line `[time] [LEVEL] [CODE] message` for each of results (doc_id, level, code, message); `at` stands for the time."""
    moment = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if at is None else F.lit(at)
    results.select(F.format_string("[%s] [%s] [%s] %s", moment, "level", "code", "message").alias("value")).write.mode("append").text(path)


def write_reports(lines: DataFrame, path: str) -> None:
    """Reports (doc_id, line_no, line) as text files, a document's lines one after another; a document is never cut in two."""
    dealt = lines.repartition("doc_id").sortWithinPartitions("doc_id", "line_no")
    dealt.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_json(docs: DataFrame, path: str) -> None:
    """One JSON object a row, null fields included."""
    docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def rewrite_catalogue(rules: DataFrame, path: str, version: str, action: str, codes: list[str], new: DataFrame | None = None) -> DataFrame:
    """Write the catalogue after an action (add, remove) as path/version; before it, a backup of the old one, and afterwards a line for the audit.

    The backup is made whether or not the action changes anything; the audit has the codes that it changed. Returns the catalogue as it is now.
    """
    spark = rules.sparkSession
    rules.write.mode("overwrite").parquet(f"{path}/backup-{version}")
    before = spark.read.parquet(f"{path}/backup-{version}")
    after = C.with_rules(before, new) if action == "add" else C.without_rules(before, codes)
    after.write.mode("overwrite").parquet(f"{path}/{version}")
    now = spark.read.parquet(f"{path}/{version}")
    larger, smaller = (now, before) if action == "add" else (before, now)
    changed = larger.select("code").join(smaller.select("code"), "code", "left_anti").where(F.col("code").isin(codes))
    changed.select(F.concat(F.lit(f"{action.upper()} "), "code").alias("value")).write.mode("append").text(f"{path}/audit")
    return now
