"""Documents to records and codes, and the catalogue's tables."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .. import shared
from ..functions import leaves as L
from ..functions import text as X
from ..sources import shards
from . import catalogue

#: The source's names of subject lists, in order of preference.
SUBJECT_LISTS = ("openlib_subject", "zlib_category_name", "rgb_subject", "sciencereading_category", "edsebk_subject", "lgrsnf_topic", "nexusstc_tag")


def _at(path: str) -> Column:
    return F.try_variant_get("doc", f"$._source.{path}", "variant")


def _searched(name: str) -> Column:
    return _at(f"search_only_fields.search_{name}")


def _unified(name: str) -> Column:
    return _at(f"file_unified_data.{name}")


def subjects_of(lists: list[Column]) -> Column:
    """Meaningful subjects in order; the first of those that differ in ASCII case only."""
    found = F.filter(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), X.meaningful)
    first = lambda low: F.filter(low, lambda x, i: F.array_position(F.transform(low, lambda y: y["low"]), x["low"]) == i + 1)
    some = L.once(F.transform(found, lambda x: F.struct(x.alias("text"), X.ascii_lower(x).alias("low"))), first)
    return F.nullif(F.array_join(F.transform(some, lambda x: x["text"]), " ; "), F.lit(""))


def codes_of(strict: bool = True) -> Column:
    def of(kind: str) -> Column:
        values = F.coalesce(L.trimmed(_unified(f"identifiers_unified.{kind}"), strict), F.array().cast("array<string>"))
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(*map(of, S.CODE_KINDS))


def flattened(docs: DataFrame, strict: bool = True) -> DataFrame:
    """doc (VARIANT) to the record's columns and codes; other columns stay. A document without id is an error."""
    one = lambda v: L.first(L.cleaned(v, strict))
    either = lambda s, u: F.coalesce(one(_searched(s)), one(_unified(u)))
    code = lambda k: L.first(L.trimmed(_unified(f"identifiers_unified.{k}"), strict))
    description = F.coalesce(one(_unified("stripped_description_best")), X.none_if_empty(F.array_join(L.cleaned(_unified("stripped_description_additional"), strict), "\n\n")), one(_searched("description_comments")))
    columns = {
        "aa_id": F.coalesce(L.first(L.trimmed(_at("id"), strict)), F.raise_error(F.lit("a document has no identifier"))),
        "md5": code("md5"), "isbn13": code("isbn13"), "doi": code("doi"),
        "title": either("title", "title_best"), "author": either("author", "author_best"), "publisher": either("publisher", "publisher_best"), "edition_varia": either("edition_varia", "edition_varia_best"),
        "subjects": subjects_of([L.cleaned(_unified(f"classifications_unified.{x}"), strict) for x in SUBJECT_LISTS]), "description": description,
        "year": L.year(_searched("year"), strict), "language": either("most_likely_language_code", "most_likely_language_codes"), "extension": either("extension", "extension_best"), "content_type": either("content_type", "content_type_best"),
        "filesize": F.coalesce(L.integers(_searched("filesize"), strict), L.integers(_unified("filesize_best"), strict)), "added_date": either("added_date", "added_date_best"), "primary_source": one(_searched("record_primary_source")),
        "score_base_rank": L.integers(_searched("score_base_rank"), strict), "cover_url": one(_unified("cover_url_best")), "original_filename": either("original_filename", "original_filename_best"),
        "has_aa_downloads": L.flags(_unified("has_aa_downloads"), strict), "has_torrent_paths": L.flags(_unified("has_torrent_paths"), strict), "local_path": F.lit(None).cast("string"), "codes": codes_of(strict),
    }
    return docs.select(*(c for c in docs.columns if c != "doc"), *(v.alias(k) for k, v in columns.items()))


def codes_by_row(rows: DataFrame) -> DataFrame:
    """rid, ord, kind, value: a row for each code of flattened rows. An outer explode: from another one Spark would infer a condition on the codes,
    push it below the documents' parsing, and parse a document again for each leaf that it names."""
    return rows.select("rid", F.posexplode_outer("codes").alias("ord", "c")).where("ord IS NOT NULL").select("rid", "ord", "c.kind", "c.value")


def records_and_codes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From flattened rows with rid."""
    return rows.select(*S.RECORDS.fieldNames()), codes_by_row(rows).drop("ord")


def build(spark: SparkSession, source: str, target: str, replace: bool = False, max_shards: int | None = None, limit: int | None = None, per_shard: bool = False, strict: bool = True) -> dict:
    """Shards to a catalogue below target: counts and seconds by step.

    All tables go to a folder of this build, which a new snapshot names, so readers see the old catalogue or the whole new one. Lines are
    parsed once, and counted by the same job; records are numbered by counts of partitions and written without a shuffle."""
    since, seconds, began = catalogue.base(spark, target, replace), {}, time.time()

    def lap(step: str) -> None:
        seconds[step] = round(time.time() - began - sum(seconds.values()), 3)

    statistics: list[dict] = []

    def make(folder: str) -> catalogue.Snapshot:
        path = f"{target}/{folder}"
        paths = shards.discover(spark, source, max_shards)
        lines, told = Observation("lines"), Observation("records")
        rows = shards.read_lines(spark, paths, lines) if limit is None else shards.limited(spark, paths, limit, per_shard, f"{path}/lines")
        lap("find")
        flat = flattened(shards.parsed(rows).drop("value"), strict).observe(told, F.count("*").alias("records"), F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("codes"))
        try:
            flat.write.parquet(f"{path}/flat")
        except Exception as error:
            raise shards.explained(spark, paths, error) from error
        lap("parse")
        numbered = shards.numbered(spark.read.schema(flat.schema).parquet(f"{path}/flat"))
        statistics.append((lines.get if limit is None else {}) | told.get)
        made = catalogue.write_tables(*records_and_codes(numbered), target, folder, lap, in_order=True)
        statistics.extend(r.asDict() for r in ingest_statistics(numbered).collect())  # a row for each shard
        for name in ("flat", "lines"):
            shared.remove(spark, f"{path}/{name}")
        return made

    made = catalogue.written(spark, target, since, make)
    if made.number > 1:
        catalogue.vacuum(spark, target)
    parsed, *by_shard = statistics
    return {"records": made.counts["records"], "codes": made.counts["codes"], "parsed": parsed, "shards": by_shard, "seconds": seconds}


def ingest_statistics(rows: DataFrame) -> DataFrame:
    """shard, file, lines (those that aren't blank), records, codes of flattened rows."""
    return rows.groupBy("shard", "file").agg(F.count("*").alias("lines"), F.count("aa_id").alias("records"), F.sum(F.size("codes")).cast("bigint").alias("codes")).orderBy("shard")
