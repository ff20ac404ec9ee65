"""Polymorphic JSON leaves: a string, number, boolean, or nested array of those, as VARIANT columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is found once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _opened(items: Column) -> Column:
    """One level of nesting less; nothing else changes."""
    return F.flatten(F.transform(items, lambda v: F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))))


def _depth(v: Column) -> Column:
    """How deep the brackets of a leaf's JSON nest, strings left out."""
    brackets = F.regexp_replace(F.regexp_replace(F.to_json(v), r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, c: Column) -> Column:
        now = at["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step)["most"]


def items(v: Column, strict: bool = True) -> Column:
    """array<variant> of the scalars of a leaf, depth first; null if the leaf is null or absent. An object, or a null inside an array,
    is an error, or is left out where not strict. Arrays of one kind of scalar, which their kind tells, aren't looked at for depth."""

    def opened(x: Column) -> Column:
        kind, leaf = x["kind"], x["leaf"]
        deep = F.aggregate(F.array_repeat(F.lit(0), _depth(leaf)), F.array(leaf), lambda found, _: _opened(found))
        flat = F.try_variant_get(leaf, "$", "array<variant>")
        return F.when(kind.rlike("^ARRAY<(ARRAY|VARIANT|VOID)"), deep).when(kind.startswith("ARRAY"), flat).when(kind != "VOID", F.array(leaf))

    whole = once(F.struct(_kind(v).alias("kind"), v.alias("leaf")), opened)
    bad = lambda k: k.isNull() | (k == "VOID") | k.startswith("OBJECT")
    if not strict:
        return F.filter(whole, lambda x: ~bad(_kind(x)))
    error = F.raise_error(F.lit("a leaf holds a null or an object"))
    return F.transform(whole, lambda x: F.when(bad(_kind(x)), error).otherwise(x))


def as_text(v: Column) -> Column:
    """Numbers as their shortest plain digits, booleans as words."""
    kind = _kind(v)
    number = F.try_variant_get(v, "$", "double")
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 1e37), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
    plain = F.try_variant_get(v, "$", "string")
    cut = F.when(plain.rlike(r"^-?[0-9]+\.[0-9]*$"), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(kind == "DOUBLE", whole).when(kind.startswith("DECIMAL"), cut).otherwise(plain)


def texts(v: Column, strict: bool = True) -> Column:
    return F.transform(items(v, strict), as_text)


def cleaned(v: Column, strict: bool = True) -> Column:
    return F.filter(F.transform(texts(v, strict), X.spaced), lambda x: x != "")


def trimmed(v: Column, strict: bool = True) -> Column:
    return F.filter(F.transform(texts(v, strict), X.stripped), lambda x: x != "")


def first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def integers(v: Column, strict: bool = True) -> Column:
    """First value of a leaf that is an integer: integral numbers, booleans as 0 and 1, strict decimal strings."""
    def one(x: Column) -> Column:
        kind, number = _kind(x), F.try_variant_get(x, "$", "double")
        text = X.trimmed(F.try_variant_get(x, "$", "string"))
        whole = F.when(number == F.floor(number), F.try_variant_get(x, "$", "decimal(38,10)").try_cast("bigint"))
        return F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("bigint")).when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))).when(kind == "BIGINT", F.try_variant_get(x, "$", "bigint")).otherwise(whole)

    return first(F.filter(F.transform(items(v, strict), one), lambda x: x.isNotNull()))


def flags(v: Column, strict: bool = True) -> Column:
    """First value of a leaf that reads as a flag: 1, 0."""
    def one(x: Column) -> Column:
        kind, word = _kind(x), X.ascii_lower(X.trimmed(F.try_variant_get(x, "$", "string")))
        said = F.when(word.isin("1", "true", "yes"), F.lit(1)).when(word.isin("0", "false", "no"), F.lit(0))
        return F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int")).when(kind == "STRING", said).otherwise((F.try_variant_get(x, "$", "double") != 0).cast("int"))

    return first(F.filter(F.transform(items(v, strict), one), lambda x: x.isNotNull())).cast("bigint")


def year(v: Column, strict: bool = True) -> Column:
    found = first(trimmed(v, strict))
    return F.when(found.rlike("^[0-9]{4}$"), found.cast("int"))
