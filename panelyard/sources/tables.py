"""Table sinks: append-only logs, fully replaced tables, files for people."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

REPLACE_ATTEMPTS = 20


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def file_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, p = _files(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears complete, by one rename; False if there is one of that name."""
    fs, target = _files(spark, path)
    folder, name = path.rsplit("/", 1)
    _, draft = _files(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    context = spark.sparkContext
    files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), context._jsc.hadoopConfiguration())
    # without options the rename refuses a name that is taken
    options = context._gateway.new_array(getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
        return True
    except Py4JJavaError as problem:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in problem.java_exception.getClass().getName():
            return False
        raise


def age_hours(spark: SparkSession, path: str) -> float:
    fs, p = _files(spark, path)
    return (time.time() * 1000 - fs.getFileStatus(p).getModificationTime()) / 3_600_000


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _files(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def delete_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return bool(fs.delete(p, True))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite_parts(df: DataFrame, path: str, part: str) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a replaced table, oldest first."""
    found = [f for f in subfolders(spark, path) if f.startswith("v") and f[1:].isdigit()]
    return [int(f[1:]) for f in found if exists(spark, f"{path}/{f}/_SUCCESS")]


def replace(df: DataFrame, path: str, version: int | None = None) -> int:
    """Write a new version beside the old ones. Readers move to it once its commit
    marker exists, so a failed write leaves the previous content in place. A number that
    another writer took meanwhile is left to it; a given number is overwritten."""
    if version is not None:
        df.write.mode("overwrite").parquet(f"{path}/v{version:09d}")
        return version
    for _ in range(REPLACE_ATTEMPTS):
        taken = [int(f[1:]) for f in subfolders(df.sparkSession, path) if f.startswith("v") and f[1:].isdigit()]
        number = max(taken, default=-1) + 1
        try:
            df.write.mode("errorifexists").parquet(f"{path}/v{number:09d}")
            return number
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_ALREADY_EXISTS":
                raise
    raise RuntimeError(f"other writers took every new version of {path}")


def prune(spark: SparkSession, path: str, keep: int = 3) -> list[int]:
    """Remove all but the newest complete versions. Returns what was removed."""
    old = versions(spark, path)[: -max(keep, 1)]
    for number in old:
        delete_folder(spark, f"{path}/v{number:09d}")
    return old


def read_current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Latest complete version, or an empty table."""
    held = versions(spark, path)
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v{held[-1]:09d}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
