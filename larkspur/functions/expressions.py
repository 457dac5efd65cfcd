"""Column expressions that keep an analytics database's meaning where Spark's own differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_values(*parts: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *parts)


def months_between(later: Column, earlier: Column) -> Column:
    """Month boundaries crossed."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("long")


def hours_between(later: Column, earlier: Column) -> Column:
    """Hour boundaries crossed."""
    hour = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / 3600)
    return (hour(later) - hour(earlier)).cast("long")


def days_between(later: Column, earlier: Column) -> Column:
    """Day boundaries crossed."""
    return F.datediff(F.to_date(later), F.to_date(earlier)).cast("long")


def ordinal(column: Column, values: list[str]) -> Column:
    """Place of a value in an ordered list, from 0; null if it is none of them."""
    place = F.array_position(F.array(*map(F.lit, values)), column)
    return F.when(place > 0, place - 1)


def normal_phone(column: Column) -> Column:
    """Digits; a country code 86 goes if an 11-digit number that begins with 1 is left; empty becomes null."""
    digits = F.regexp_replace(column, "[^0-9]", "")
    return F.nullif(F.regexp_replace(digits, "^(?:00)?86(?=1[0-9]{10}$)", ""), F.lit(""))


def normal_email(column: Column) -> Column:
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


def normal_name(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def pseudonym(column: Column, salt: str) -> Column:
    """Salted SHA-256 in hexadecimal."""
    return F.sha2(F.concat(F.lit(salt), column), 256)


def mask_phone(column: Column) -> Column:
    """Middle digits hidden."""
    return F.concat(F.substring(column, 1, 3), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(column) - 7)), F.substring(column, -4, 4))


def mask_name(column: Column) -> Column:
    """All but the first character hidden."""
    return F.concat(F.substring(column, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(column) - 1)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common characters of two strings, as sets."""
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.try_divide(F.size(F.array_intersect(chars(a), chars(b))).cast("double"), F.size(F.array_union(chars(a), chars(b))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters; a single character stands for itself."""
    one = F.split(text, "")
    pairs = F.zip_with(one, F.slice(one, 2, F.greatest(F.size(one) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) >= 2, F.slice(pairs, 1, F.size(one) - 1)).when(F.length(text) == 1, F.array(text)).otherwise(F.array().cast("array<string>"))
