"""The test tables as a catalogue: documents and labels as records, codes and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import catalogue as G
from ..operators import ingest as I
from ..operators import linking as K
from ..operators import matching
from ..schema import RECORDS
from ..shared import shared_dir
from ..sources import shards as S


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    title = F.regexp_extract("text", r"^[^.]*", 0)
    columns = {
        "rid": F.col("doc_id"), "aa_id": F.concat(F.lit("doc:"), F.col("doc_id")), "md5": F.md5("text"), "isbn13": (F.lit(9780000000000) + F.col("doc_id")).cast("string"), "doi": F.concat(F.lit("10.1/D"), F.col("doc_id")),
        "title": title, "author": F.col("source"), "publisher": F.col("source"), "description": F.col("text"), "year": (F.lit(2000) + F.col("doc_id") % 25).cast("int"), "language": F.col("lang"),
        "extension": F.lit("txt"), "filesize": F.col("n_chars"), "score_base_rank": (F.col("quality") * 10).cast("bigint"), "original_filename": F.concat(title, F.lit(".txt")),
    }
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORDS.fields))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("md5", "isbn13", "doi")))
    return rows.select("rid", F.explode(every).alias("c")).select("rid", "c.kind", "c.value")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: named by md5, by isbn, by title, or by source and title, in turn."""
    r = records(spark, sf_dir)
    turn = F.col("rid") % 4
    name = F.when(turn == 0, F.concat("md5", F.lit(".bin"))).when(turn == 1, F.concat(F.lit("scan "), "isbn13", F.lit(" x.pdf"))).when(turn == 2, F.upper(F.regexp_replace("original_filename", "/", "_"))).otherwise(F.concat("author", F.lit(" - "), F.substring(F.regexp_replace("title", "/", "_"), 1, 60), F.lit(".epub")))
    return r.select(F.concat(F.lit("/files/"), F.lpad(F.col("rid").cast("string"), 9, "0"), F.lit("/"), name).alias("path"), F.lit(None).cast("string").alias("content_md5"))


_built: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, kind: str, make) -> str:
    """The folder that make filled, once for each application, test folder and kind."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _built:
        path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        make(path)
        _built[key] = path
    return _built[key]


def _commit(spark: SparkSession, target: str, records_: DataFrame, codes_: DataFrame, indexed: bool = True) -> None:
    G.written(spark, target, G.base(spark, target), lambda folder: G.write_tables(records_, codes_, target, folder, indexed=indexed))


def stored(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "catalogue", lambda path: _commit(spark, path, records(spark, sf_dir), codes(spark, sf_dir)))


def catalogue(spark: SparkSession, sf_dir: str) -> G.Catalogue:
    """The test tables as a stored catalogue with its index."""
    return G.opened(spark, stored(spark, sf_dir))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a catalogue after two runs that linked the files: those of even documents, then all. Links change nothing that
    files are matched by, so both runs look into the same records by term; nothing reads an index of the catalogue's."""

    def make(path: str) -> None:
        _commit(spark, path, records(spark, sf_dir), codes(spark, sf_dir), indexed=False)
        packed = matching.packed(G.opened(spark, path, searched=False).records)
        for some in (files(spark, sf_dir).where(F.substring("path", 16, 1).isin(*"02468")), files(spark, sf_dir)):
            K.link(spark, some, G.opened(spark, path, searched=False), path, replace=True, packed=packed)

    return G.opened(spark, _once(spark, sf_dir, "linked", make), searched=False).records


def in_batches(spark: SparkSession, sf_dir: str) -> G.Catalogue:
    """The test tables as a catalogue of three batches."""

    def make(path: str) -> None:
        for n in range(3):
            mine = lambda df: df.where(F.col("rid") % 3 == n)  # noqa: B023, E731
            G.append(spark, path, lambda last: (mine(records(spark, sf_dir)), mine(codes(spark, sf_dir))), "test", n)  # noqa: B023

    return G.opened(spark, _once(spark, sf_dir, "batches", make))


SHARDS = 7


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, j: documents as JSON of the source's shape."""
    r = records(spark, sf_dir)
    more = [
        F.when(F.col("rid") % 4 == 0, F.concat(F.lit("ed. "), "rid")).alias("search_edition_varia"), F.lit("book").alias("search_content_type"), F.concat(F.lit("2020-01-0"), F.col("rid") % 9).alias("search_added_date"), F.lit("prim").alias("search_record_primary_source"),
        F.when(F.col("rid") % 5 == 0, F.concat("author", F.lit(".x"))).alias("search_original_filename"), F.when(F.col("rid") % 3 == 0, F.col("rid")).alias("search_score_base_rank"),
    ]
    searched = F.struct(*more, F.concat(F.lit("  "), "title", F.lit("\t")).alias("search_title"), F.when(F.col("rid") % 3 == 0, F.col("author")).alias("search_author"), F.array("language", F.lit("zz")).alias("search_most_likely_language_code"), F.col("filesize").cast("string").alias("search_filesize"), F.concat("year", F.when(F.col("rid") % 2 == 0, "").otherwise("?")).alias("search_year"))
    unified = F.struct(
        F.lit("alt").alias("edition_varia_best"), F.concat(F.lit("http://c/"), "rid").alias("cover_url_best"), F.lit("o").alias("original_filename_best"), F.when(F.col("rid") % 2 == 0, "true").otherwise("1.5").alias("extension_best"),
        F.concat(F.lit("u-"), "author").alias("author_best"), F.array(F.lit(" "), F.col("publisher")).alias("publisher_best"), F.array(F.concat(F.lit("part "), "rid"), F.lit(""), F.lit("two\n parts")).alias("stripped_description_additional"), (F.col("rid") % 2 == 0).alias("has_aa_downloads"), (F.col("rid") % 3).alias("has_torrent_paths"),
        F.struct(F.array("md5", "md5").alias("md5"), F.col("isbn13").alias("isbn13"), F.array(F.concat(F.lit(" "), "doi"), F.col("isbn13")).alias("doi")).alias("identifiers_unified"),
        F.struct(F.array(F.lit("History"), F.col("author"), F.lit("/a/b")).alias("openlib_subject"), F.array(F.lit("HISTORY"), F.col("language"), F.lit("0123456789abcdef")).alias("lgrsnf_topic")).alias("classifications_unified"),
    )
    return r.select("rid", F.to_json(F.struct(F.struct(F.col("aa_id").alias("id"), searched.alias("search_only_fields"), unified.alias("file_unified_data")).alias("_source"))).alias("j"))


def shards(spark: SparkSession, sf_dir: str) -> str:
    """A folder of gzipped shards of documents, dealt by number, with blank lines between them."""

    def make(path: str) -> None:
        lines = sources(spark, sf_dir).select((F.col("rid") % SHARDS).alias("n"), "rid", F.explode(F.array("j", F.lit(" "))).alias("value"))
        lines.repartition("n").sortWithinPartitions("n", "rid").select("n", "value").write.partitionBy("n").option("compression", "gzip").text(f"{path}/parts")
        for n in range(SHARDS):
            for name in shared.names(spark, f"{path}/parts/n={n}"):
                if name.startswith("part-"):
                    shared.move(spark, f"{path}/parts/n={n}/{name}", f"{path}/aarecords__{n}.json.gz")

    return _once(spark, sf_dir, "shards", make)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the shards, written once."""
    path = _once(spark, sf_dir, "lines", lambda path: S.read_lines(spark, S.discover(spark, shards(spark, sf_dir))).write.parquet(path))
    return spark.read.schema(S.LINES).parquet(path)


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a catalogue that was built from shards."""
    return G.opened(spark, _once(spark, sf_dir, "built", lambda path: I.build(spark, shards(spark, sf_dir), path))).records


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of one that was built from the first 100 lines, and those of one from the first 50 dealt over the shards."""
    whole = lambda per, n: G.opened(spark, _once(spark, sf_dir, f"limited-{per}", lambda path: I.build(spark, shards(spark, sf_dir), path, limit=n, per_shard=per))).records.withColumn("per_shard", F.lit(per))
    return whole(False, 100).unionByName(whole(True, 50))


RECORDS_SQL = """records AS (
SELECT d.doc_id AS rid, 'doc:' || d.doc_id AS aa_id, md5(text) AS md5, CAST(9780000000000 + d.doc_id AS VARCHAR) AS isbn13, '10.1/D' || d.doc_id AS doi,
split_part(text, '.', 1) AS title, source AS author, source AS publisher, text AS description, CAST(2000 + d.doc_id % 25 AS INTEGER) AS year, lang AS language, 'txt' AS extension,
n_chars AS filesize, CAST(l.quality * 10 AS BIGINT) AS score_base_rank, split_part(text, '.', 1) || '.txt' AS original_filename
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
CODES_SQL = """codes AS (SELECT rid, 'md5' AS kind, md5 AS value FROM records UNION ALL SELECT rid, 'isbn13', isbn13 FROM records UNION ALL SELECT rid, 'doi', doi FROM records)"""
