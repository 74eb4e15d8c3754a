"""String normalisation as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that mean "missing", compared in upper case.
NULL_TOKENS = ("", "NA", "NAN", "NULL", "NONE")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c: Column | str) -> Column:
    """Trimmed text; null and the NULL_TOKENS become the empty string."""
    t = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(F.upper(t).isin(*NULL_TOKENS), F.lit("")).otherwise(t)


def source_name(c: Column | str) -> Column:
    """One of the four collection names whatever the case, spaces or joiners; other text stays as letters only.

    Null and text without a letter give null.
    """
    k = F.regexp_replace(F.lower(col(c)), "[^a-z]", "")
    return F.when(k == "yolobruv", F.lit("yolo-bruv")).when(k == "", F.lit(None).cast("string")).otherwise(k)


def snake_name(c: Column | str) -> Column:
    """Lower case with runs of other characters as one underscore (kinds of text)."""
    k = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(k == "", F.lit(None).cast("string")).otherwise(k)


def place_key(c: Column | str) -> Column:
    """Comparison key of a deployment name: case, joiners and leading zeros do not count.

    Joiners survive only between two digits, where dropping them would change a number.
    """
    k = F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", " ")
    k = F.regexp_replace(k, "(?<![0-9])0+(?=[0-9])", "")
    k = F.regexp_replace(F.trim(k), "(?<=[0-9]) (?=[0-9])", "_")
    k = F.regexp_replace(k, " ", "")
    return F.when(k == "", F.lit(None).cast("string")).otherwise(k)


def crop_name(c: Column | str) -> Column:
    """A crop key as stored: lower case, hyphens, no image suffix, no outer space."""
    k = F.regexp_replace(F.lower(F.trim(F.regexp_replace(col(c), "\\s+", " "))), "\\.(jpe?g|png)$", "")
    return F.regexp_replace(k, "_", "-")


def url_name(c: Column | str) -> Column:
    """A frame URL without its spelling: scheme, host case, outer space and percent escapes do not count.

    Bad escapes are left as written; ``+`` is kept.
    """
    t = F.trim(F.regexp_replace(col(c), "^\\s+|\\s+$", ""))
    t = F.regexp_replace(t, "(?i)^https?://", "")
    t = F.coalesce(F.try_url_decode(F.regexp_replace(t, "\\+", "%2B")), t)
    host = F.lower(F.regexp_extract(t, "^([^/]*)", 1))
    return F.concat(host, F.regexp_extract(t, "^[^/]*(.*)$", 1))


def uid(prefix: str, path: Column | str, size: int = 10) -> Column:
    """``prefix-`` and the first hex digits of the SHA-256 of a path with forward slashes."""
    rel = F.regexp_replace(col(path).cast("string"), r"\\", "/")
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(rel, 256), 1, size))


def hash_order(*parts: Column | str, sep: str = ":") -> Column:
    """A reproducible random order: the SHA-256 of the joined parts, as hex."""
    return F.sha2(F.concat_ws(sep, *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def seed64(*parts: Column | str, sep: str = "|") -> Column:
    """First 16 hex digits of hash_order as an unsigned 64-bit number (decimal(20,0))."""
    return F.conv(F.substring(hash_order(*parts, sep=sep), 1, 16), 16, 10).cast("decimal(20,0)")
