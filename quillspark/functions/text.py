"""Text functions as Column expressions: white space, ASCII case, identifiers, tokens, file names."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms that say nothing of a work.
NOISE = (
    "ebook", "book", "books", "scan", "scanned", "ocr", "libgen", "zlib", "epub", "pdf", "djvu", "mobi", "azw3", "azw", "fb2", "edition", "ed", "vol", "volume", "v2", "v3", "retail", "fixed", "clean",
    "text", "author", "title",
)


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def spaced(c: Column) -> Column:
    """White space runs of any script as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """spaced; empty is null."""
    return none_if_empty(spaced(c))


def trimmed(c: Column) -> Column:
    return none_if_empty(stripped(c))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def normal_query(c: Column) -> Column:
    return ascii_lower(clean(c))


def for_match(c: Column) -> Column:
    """ASCII letters and digits in lower case; all else is a space."""
    return F.trim(F.regexp_replace(ascii_lower(c), "[^0-9a-z]+", " "))


def significant(c: Column) -> Column:
    """Terms of a for_match() text that tell works apart; order and repeats stay."""
    return F.filter(F.split(c, " "), lambda t: (F.length(t) >= 3) & t.rlike("[a-z]") & ~t.isin(*NOISE))


def hash_like(c: Column) -> Column:
    return c.rlike("^[0-9A-Fa-f]{16,}$")


def meaningful(c: Column) -> Column:
    low = ascii_lower(c)
    path = c.rlike(r"^(/|\./|\.\./|~/)") | c.contains("\\") | low.contains("://") | low.contains(".torrent")
    return (F.octet_length(c) <= 300) & c.rlike(r"\p{IsAlphabetic}") & ~path & ~hash_like(c)


def expandable(c: Column) -> Column:
    return ~c.contains("/") & ~c.contains("\\") & ~hash_like(F.regexp_replace(c, r"(?U)\s", "")) & c.rlike("[A-Za-z]")


def md5_candidates(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit("[0-9A-Fa-f]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(runs, lambda t: F.length(t) == 32), ascii_lower))


def isbn_runs(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9Xx-]+"), F.lit(0)), lambda t: F.upper(F.replace(t, F.lit("-"), F.lit(""))))


def isbn13_candidates(c: Column) -> Column:
    return F.array_distinct(F.filter(isbn_runs(c), lambda t: t.rlike("^[0-9]{13}$")))


def isbn10_candidates(c: Column) -> Column:
    return F.array_distinct(F.filter(isbn_runs(c), lambda t: t.rlike("^[0-9]{9}[0-9X]$")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(name: Column) -> Column:
    """Up to the last dot; a name with its only dot in front stays."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, '/\\\0:*?"<>|', "_" * 10), r"(?U)^\s+|\s+$", "")


def _folding() -> tuple[str, str]:
    """Letters with marks and the letters below them, from the Unicode decompositions."""
    pairs = {}
    for code in range(0xC0, min(0x2000, sys.maxunicode)):
        whole = unicodedata.normalize("NFD", chr(code))
        base = "".join(x for x in whole if not unicodedata.category(x).startswith("M"))
        if len(base) == 1 and base != chr(code) and len(whole) > 1:
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


MARKED, BARE = _folding()


def tokens(c: Column) -> Column:
    """Index terms: runs of letters and digits of any script, in lower case, without diacritics. Null has none."""
    folded = F.translate(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{M}", "")), MARKED, BARE)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")
