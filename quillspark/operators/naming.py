"""Names of fetched files, and decisions about files that are there."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

MODES = ("original", "aa_id", "md5", "flat")


def default_name(mode: str) -> Column:
    blank = lambda c: X.trimmed(F.col(c))
    extension = F.when(blank("extension").isNotNull(), F.col("extension")).otherwise("bin")
    by_id = F.concat("aa_id", F.lit("."), extension)
    both = F.concat_ws(" -- ", blank("title"), blank("author"))
    names = {
        "original": F.coalesce("original_filename", by_id), "aa_id": by_id, "md5": F.concat(F.coalesce("md5", "aa_id"), F.lit("."), extension),
        "flat": F.concat(F.when(both == "", F.col("aa_id")).otherwise(both), F.lit("."), extension),
    }
    return X.safe_file_name(names[mode])


def destination(folder: str, mode: str, name: str | None = None) -> Column:
    """Where a record's file goes: below folder, under the given name, made safe, or the default one; no name left is an error."""
    safe = X.safe_file_name(F.lit(name)) if name is not None else default_name(mode)
    return F.when(F.coalesce(safe, F.lit("")) == "", F.raise_error(F.lit("no file name can be made of this record"))).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), safe))


def same_md5(a: Column, b: Column) -> Column:
    return X.ascii_lower(a) == X.ascii_lower(b)


def existing_file(exists: Column, matches: Column, replace: Column) -> Column:
    """What to do where a file may be there already."""
    return F.when(~exists, "download").when(matches, "already_present").when(replace, "download").otherwise("error")


def resume(status: int, offset: int, content_range: str | None) -> str:
    """append, restart, complete or error for an answer to a request from offset on."""
    if status == 206:
        got = re.match(r"bytes (\d+)-(\d+)/(\d+|\*)$", content_range or "")
        return "append" if got and int(got[1]) == offset <= int(got[2]) else "error"
    if status == 416:
        got = re.match(r"bytes \*/(\d+)$", content_range or "")
        return "complete" if got and int(got[1]) == offset else "restart"
    return "restart" if status == 200 else "error"
