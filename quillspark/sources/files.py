"""Local files: names and contents, through the Hadoop file system and Spark's binary source, so that a root may be in any store that Spark reads."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = 1 << 30  # bytes of a file that a task reads whole; a longer one is read as a stream
LISTERS = 16


def _hidden(name: str) -> bool:
    """Names that Spark's sources pass over."""
    return name.startswith((".", "_"))


def _plain(path: str) -> str:
    """A path of this machine without its scheme; others as they are."""
    return path.removeprefix("file:") if path.startswith("file:/") else path


def walked(spark: SparkSession, root: str, most: int | None = None) -> list[tuple[str, int, bool]]:
    """path, bytes, and whether Spark's sources see it, of the files below root, in order of their paths, folder by folder. Folders
    of one depth are listed side by side; links are not followed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(root)

    def listed(folder) -> tuple[list, list]:
        path, seen = folder
        below, found = [], []
        for s in fs.listStatus(path):
            name, full = s.getPath().getName(), s.getPath()
            local = full.toString().startswith("file:")  # whose status follows links
            if spark._jvm.java.nio.file.Files.isSymbolicLink(spark._jvm.java.io.File(full.toUri().getPath()).toPath()) if local else s.isSymlink():
                continue
            if s.isDirectory():
                below.append((full, seen and not _hidden(name)))
            else:
                found.append((_plain(full.toString()), s.getLen(), seen and not _hidden(name)))
        return below, found

    folders, files = [(fs.makeQualified(at), True)], []
    with ThreadPoolExecutor(LISTERS) as pool:
        while folders:
            parts = list(pool.map(listed, folders))
            folders = [f for below, _ in parts for f in below]
            files += [f for _, found in parts for f in found]
    return sorted(files, key=lambda f: f[0].split("/"))[:most]


def _streamed(spark: SparkSession, paths: list[str]) -> list[tuple[str, str | None, str | None]]:
    """path, md5, error of files that the binary source doesn't read."""
    from py4j.protocol import Py4JJavaError

    def digest(path: str):
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
            try:
                return path, spark._jvm.org.apache.hadoop.io.MD5Hash.digest(stream).toString(), None
            finally:
                stream.close()
        except Py4JJavaError as error:
            return path, None, error.java_exception.getClass().getSimpleName()

    with ThreadPoolExecutor(LISTERS) as pool:
        return list(pool.map(digest, paths))


def local_files(spark: SparkSession, root: str, most: int | None = None, contents: bool = False) -> DataFrame:
    """path, content_md5 and error of the files below root, the first ``most`` in order of their paths. Hidden files are files; links are not.

    With contents, executors read files by Spark's binary source and digest them; hidden files, which that source passes over, and files of more than
    ``WHOLE`` bytes are streamed beside. A file that can't be read has an error instead of a digest."""
    found = walked(spark, root, most)
    schema = "path string, content_md5 string, error string"
    if not contents:
        return spark.createDataFrame([(p, None, None) for p, _, _ in found], schema)
    plain = [(p,) for p, size, seen in found if seen and 0 < size <= WHOLE]
    apart = [p for p, size, seen in found if size and (not seen or size > WHOLE)]
    empty = [(p, hashlib.md5(b"").hexdigest(), None) for p, size, _ in found if not size]  # which the source passes over too
    rows = spark.createDataFrame(_streamed(spark, apart) + empty, schema)
    if not plain:
        return rows
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    digests = read.where(F.col("length") <= WHOLE).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.md5("content").alias("content_md5"))
    joined = spark.createDataFrame(plain, "path string").join(digests, "path", "left")
    return joined.select("path", "content_md5", F.when(F.col("content_md5").isNull(), "unreadable").alias("error")).unionByName(rows)
