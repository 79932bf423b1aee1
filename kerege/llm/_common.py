"""What the text operators share: tables in the shared folder, words."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the only characters that separate words here.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

#: A-Z to a-z on UTF-8 bytes; bytes of other characters stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode alone, and RuntimeError where a cluster's session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kerege-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/kerege/{spark.sparkContext.applicationId}"


def cleared(spark: SparkSession) -> None:
    """Delete all tables that written() has made in this application; results that haven't been read to their end need them."""
    _deleted(spark, own_folder(spark))


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark._jvm.System.gc()  # else the shuffle files of what is written now stay until the driver's heap fills
    out = spark.read.schema(df.schema).parquet(path)
    out._kerege_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    path = getattr(df, "_kerege_path", None)
    if path:
        _deleted(df.sparkSession, path)


#: Columns that operators on whole rows read by name.
_READ = ("doc_id", "text", "lang", "source")


def keeps_names(run):
    """For functions from docs to some of its rows: whatever other columns are called, the function sees neutral names, and its result has the old ones."""

    @functools.wraps(run)
    def plain(docs: DataFrame, *args, **more) -> DataFrame:
        neutral = docs.toDF(*[n if n in _READ else f"c{k}" for k, n in enumerate(docs.columns)])
        return run(neutral, *args, **more).toDF(*docs.columns)

    return plain


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0)), F.array().cast("array<string>"))


def bounded(df: DataFrame, mb: float) -> bool:
    """Is the optimizer's size of df at most so many MB? Tables just read from files have an exact one."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue()) <= mb * 1e6


#: Groups with over one row in HOT_SHARE are at most as many, so that they can always be broadcast.
HOT_SHARE = 1000


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows with the columns of groups (key, n, ...), n the number of rows of the group; null keys meet, every row has a group.

    Groups with over one row in HOT_SHARE go by broadcast, at most HOT_SHARE of them whatever the table, so that no task gets a
    hot key; all others meet by shuffle. groups is read twice and best written.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    groups = groups.withColumnRenamed(key, "__group")
    hot, others = (groups.where(test).drop("n") for test in (F.col("n") * HOT_SHARE > total, F.col("n") * HOT_SHARE <= total))
    found = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), F.col(key).eqNullSafe(F.col("__group")), "left")
    many = found.where("__hot")
    few = found.where("__hot is null").select(*rows.columns).join(others, F.col(key).eqNullSafe(F.col("__group")))
    return many.drop("__hot", "__group").unionByName(few.drop("__group"))
