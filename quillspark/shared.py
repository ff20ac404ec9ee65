"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Python workers of a local session find this package though it isn't installed."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, paths)))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and the session is a local one, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/quillspark-shared"
    return found


def stored(df: DataFrame) -> DataFrame:
    """df written once, as Parquet, and read again: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _aside(spark: SparkSession, path: str, content: dict):
    """JSON in one small file beside path: the file context, the file and path."""
    fs, at = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    return context, context.makeQualified(aside), context.makeQualified(at)


def _renamed(spark: SparkSession, context, aside, at, option: str) -> None:
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = getattr(rename, option)
    context.rename(aside, at, options)


def write_text(spark: SparkSession, path: str, content: dict) -> None:
    """JSON to one small file that appears whole: written aside, then renamed over the old one."""
    _renamed(spark, *_aside(spark, path, content), "OVERWRITE")


def write_new(spark: SparkSession, path: str, content: dict) -> bool:
    """The same where no file has that name; else False. Of several writers one succeeds, as far as the file system renames in one step."""
    from py4j.protocol import Py4JJavaError

    context, aside, at = _aside(spark, path, content)
    try:
        _renamed(spark, context, aside, at, "NONE")
    except Py4JJavaError as error:
        remove(spark, aside.toString())
        if exists(spark, path):
            return False
        raise error
    return True


def read_text(spark: SparkSession, path: str) -> dict | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str, folders: bool = False) -> list[str]:
    """Names of the files, or of the folders, in a folder; none where there is no such folder."""
    fs, at = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory() == folders] if fs.exists(at) else []


def changed(spark: SparkSession, path: str) -> float:
    """When a folder, or one of the tables in it, was last changed: seconds since 1970."""
    fs, at = _fs(spark, path)
    return max([fs.getFileStatus(at).getModificationTime(), *(f.getModificationTime() for f in fs.listStatus(at))]) / 1000


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, at = _fs(spark, source)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} could not be renamed to {target}")
