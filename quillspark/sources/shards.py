"""Gzipped NDJSON shards and local files."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .. import shared

PATTERN = r"^aarecords__(.*)\.json\.gz$"
BLANK = r"^[ \t\n\r\f]+|[ \t\n\r\f]+$"
LAST = 4294967295
LINES = StructType([StructField("shard", IntegerType()), StructField("file", StringType()), StructField("block", LongType()), StructField("at", LongType()), StructField("value", StringType())])


def shard_number(name: Column) -> Column:
    text = F.regexp_extract(name, PATTERN, 1)
    value = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))
    return F.when(value < LAST, value).otherwise(F.lit(LAST))


def shard_key(name: str) -> tuple[int, str]:
    """The order of shards by name."""
    number = name[len("aarecords__") : -len(".json.gz")].removeprefix("+")
    return (min(int(number), LAST) if number.isascii() and number.isdigit() else LAST, name)


def discover(spark: SparkSession, path: str, most: int | None = None) -> list[str]:
    """Paths of the shards of a folder in order of their numbers, then names; a file stands for itself. Names only are read here."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isFile():
        return [path]
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isFile()]
    found = sorted((n for n in names if n.startswith("aarecords__") and n.endswith(".json.gz")), key=shard_key)
    if not found:
        raise FileNotFoundError(f"no shards in {path}")
    return [f"{path.rstrip('/')}/{n}" for n in found[:most]]


def spread(limit: int, shards: int) -> list[int]:
    """A limit dealt evenly, the first shards taking the remainder."""
    return [limit // shards + (at < limit % shards) for at in range(shards)]


def _uri(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:/", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())


def _literal(path: str) -> str:
    """path for Spark's readers, which would take its brackets, braces, stars and question marks for a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def lines_of(text: DataFrame) -> DataFrame:
    """value, file, path and block (where its split of the file begins) of a text source, also one that streams."""
    return text.select("value", F.col("_metadata.file_name").alias("file"), F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def placed(lines: DataFrame, uris: list[str], told: Observation | None = None) -> DataFrame:
    """shard (place of the line's path in uris), file, block and at, value: the lines that aren't blank. at rises by one with each line of a split, so
    ``numbered`` can tell a line's place. told gets lines and blank, counted by the job that reads."""
    rows = lines.withColumn("value", F.regexp_replace("value", BLANK, ""))
    if told is not None:
        rows = rows.observe(told, F.count("*").alias("lines"), F.count_if(F.col("value") == "").alias("blank"))
    shards = F.broadcast(lines.sparkSession.createDataFrame([(u, at) for at, u in enumerate(uris)], "path string, shard int"))  # a row for each file
    rows = rows.where("value <> ''").join(shards, "path", "left")
    return rows.select(F.coalesce("shard", F.raise_error(F.concat(F.lit("no shard of path "), "path"))).alias("shard"), "file", "block", F.monotonically_increasing_id().alias("at"), "value")


def read_lines(spark: SparkSession, paths: list[str], told: Observation | None = None) -> DataFrame:
    """The lines of shards that aren't blank, as of placed."""
    return placed(lines_of(spark.read.text([_literal(p) for p in paths])), [_uri(spark, p) for p in paths], told)


def splits(rows: DataFrame) -> DataFrame:
    """shard, block, least (the first at), before and shard_before (lines in front of the split, in all and of its shard). What is collected is
    a few numbers for each split of the input."""
    found = rows.groupBy("shard", "block").agg(F.count("*").alias("n"), F.min("at").alias("least")).collect()
    out, before, shard_before, shard = [], 0, 0, None
    for r in sorted(found, key=lambda r: (r.shard, r.block)):
        if r.shard != shard:
            shard, shard_before = r.shard, 0
        out.append((r.shard, r.block, r.least, before, shard_before))
        before, shard_before = before + r.n, shard_before + r.n
    return rows.sparkSession.createDataFrame(out, "shard int, block long, least long, before long, shard_before long")


def numbered(rows: DataFrame) -> DataFrame:
    """rows of read_lines, written since, with rid in order of (shard, line) and place in the shard, both from 1. No row is moved."""
    placed = rows.join(F.broadcast(splits(rows)), ["shard", "block"])
    at = F.col("at") - F.col("least") + 1
    return placed.withColumns({"rid": at + F.col("before"), "place": at + F.col("shard_before")}).drop("least", "before", "shard_before")


def heads(rows: DataFrame, most: list[int]) -> DataFrame:
    """The first lines of each split, as many as its shard may have; rows of a split come one after the other."""

    def run(batches):
        key, left = None, 0
        for batch in batches:
            keep = []
            for at, now in enumerate(zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                if now != key:
                    key, left = now, most[now[0]]
                if left > 0:
                    keep.append(at)
                    left -= 1
            yield batch.take(pa.array(keep, pa.int32()))

    shared.importable(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)


def limited(spark: SparkSession, paths: list[str], limit: int, per_shard: bool, aside: str) -> DataFrame:
    """read_lines up to a limit, in all or dealt over the shards, from lines that are written below aside.

    A limit in all reads shards in order, one, two, four at a time, until they hold enough lines, and no later one."""
    most = spread(limit, len(paths)) if per_shard else [limit] * len(paths)
    done, held, step = 0, 0, len(paths) if per_shard else 1
    while done < len(paths) and (held < limit or not done):
        some = range(done, min(done + step, len(paths)))
        rows = read_lines(spark, paths[done : some.stop]).withColumn("shard", (F.col("shard") + done).cast("int"))
        heads(rows, most).write.parquet(f"{aside}/from={done}")
        held += spark.read.parquet(f"{aside}/from={done}").count()
        done, step = some.stop, step * 2
    rows = numbered(spark.read.schema(LINES).parquet(f"{aside}/*"))
    if not per_shard:
        return rows.where(F.col("rid") <= limit).drop("rid", "place")
    allowed = F.broadcast(spark.createDataFrame(list(enumerate(most)), "shard int, most long"))
    return rows.join(allowed, "shard").where("place <= most").select(*LINES.fieldNames())


def first_bad_line(spark: SparkSession, path: str) -> int | None:
    """The number, from 1, of the first line of a file that is not JSON, blank lines counted, from a few numbers for each split."""
    rows = spark.read.text(_literal(path)).select("value", F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    text = F.regexp_replace("value", BLANK, "")
    bad = F.when((text != "") & F.try_parse_json(text).isNull(), F.col("at"))
    before = 0
    for r in sorted(rows.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("least"), F.min(bad).alias("bad")).collect(), key=lambda r: r.block):
        if r.bad is not None:
            return before + r.bad - r.least + 1
        before += r.n
    return None


NOT_JSON = "not JSON: "


def parsed(rows: DataFrame) -> DataFrame:
    """The lines' documents as VARIANT; a bad line stops the job and names its shard's place."""
    doc = F.try_parse_json("value")
    where = F.concat(F.lit(NOT_JSON), F.lit("shard "), F.coalesce(F.col("shard").cast("string"), F.lit("-")), F.lit(";"))
    return rows.withColumn("doc", F.when(doc.isNull(), F.raise_error(where)).otherwise(doc))


def parse_line(text: str) -> dict | None:
    """One line, without Spark: the document, or None where it is blank."""
    text = text.strip(" \t\n\r\f")
    if not text:
        return None
    doc = json.loads(text)
    if not isinstance(doc, dict):
        raise ValueError("not a JSON object")
    return doc


def explained(spark: SparkSession, paths: list[str], error: Exception) -> Exception:
    """The error of a bad line with its file and line, else error itself."""
    found = re.search(NOT_JSON + r"shard (\d+);", str(error))
    if not found:
        return error
    path = paths[int(found[1])]
    return ValueError(f"{path}, line {first_bad_line(spark, path)}: not JSON")
