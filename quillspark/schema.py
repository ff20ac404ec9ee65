"""Schemas of the catalogue. Dates stay text; flags stay integers."""

from pyspark.sql import types as T

_TEXT = T.StringType()


def _fields(*pairs):
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in pairs])


VERSION = 4  # of the stored tables

#: Names of columns and code kinds, which data and callers share.
RECORDS = _fields(
    ("rid", T.LongType(), False), ("aa_id", _TEXT, False), *((c, _TEXT, True) for c in ("md5", "isbn13", "doi", "title", "author", "publisher", "edition_varia", "subjects", "description")),
    ("year", T.IntegerType(), True), *((c, _TEXT, True) for c in ("language", "extension", "content_type")), ("filesize", T.LongType(), True), ("added_date", _TEXT, True), ("primary_source", _TEXT, True),
    ("score_base_rank", T.LongType(), True), ("cover_url", _TEXT, True), ("original_filename", _TEXT, True), ("has_aa_downloads", T.LongType(), True), ("has_torrent_paths", T.LongType(), True), ("local_path", _TEXT, True),
)
RECORD_CODES = _fields(("rid", T.LongType(), False), ("kind", _TEXT, False), ("value", _TEXT, False))
STORED_CODES = T.StructType([*RECORD_CODES.fields, T.StructField("value_lc", _TEXT)])
CODE_KINDS = ("md5", "isbn10", "isbn13", "doi", "oclc", "ol", "zlib")
#: Searched columns in the order of their weights.
SEARCHED = {"title": 10.0, "author": 8.0, "subjects": 5.0, "description": 1.5, "publisher": 1.0, "edition_varia": 0.5}
RESULT = ("aa_id", "title", "author", "publisher", "year", "language", "extension", "filesize", "md5", "original_filename", "bm25_score")
SUMMARY = ("rid", "aa_id", "title", "author", "extension", "md5", "original_filename", "local_path")
