"""Scalar functions, Column to Column; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a title hash keeps.
TITLE_HASH_DROPS = "[^0-9a-z一-龥]"
#: URL schemes whose last path segment can carry parameters after a semicolon.
PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel")
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def falsy(c: Column, kind: str = "string") -> Column:
    """Null for what the JSON and graph sinks leave out: an empty string, a zero."""
    return F.nullif(c, F.lit("") if kind == "string" else F.lit(0))


def lower_id(c: Column) -> Column:
    """An id as it is compared: lower case, null for an empty one."""
    return falsy(F.lower(c))


def title_hash(c: Column) -> Column:
    """Lower-cased title with digits, a-z and common ideographs only; null for a null title, empty if nothing is left."""
    return F.regexp_replace(F.lower(c), TITLE_HASH_DROPS, "")


def doi_norm(c: Column) -> Column:
    """The path of a DOI written as text or URL: no scheme, authority, query, fragment, parameters, leading slash."""
    s = F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(s, _SCHEME, ""), r"^//[^/?#]*", "")
    rest = F.regexp_replace(rest, r"(?s)[?#].*$", "")
    rest = F.when(scheme.isin(*PARAM_SCHEMES), F.regexp_replace(rest, r";[^/]*$", "")).otherwise(rest)
    return F.regexp_replace(rest, r"^/+", "")


#: Other ways to write a whole date, tried in this order where it isn't ISO.
DATE_FORMATS = ("yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "d.M.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss")


def pub_date(c: Column) -> Column:
    """A date, written as ISO or otherwise (``DATE_FORMATS``); a bare year or year and month is its first day. Anything else
    is null; nothing is filled in from the present day."""
    iso = F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01"))).when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)
    tried = [F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in DATE_FORMATS]
    return F.when(iso.isNotNull(), iso.try_cast("date")).when(c.rlike(r"\d{4}"), F.coalesce(*tried))


def doi_alias(c: Column) -> Column:
    """``DOI:`` and the normalized DOI."""
    return F.concat(F.lit("DOI:"), doi_norm(c))


def cache_path(c: Column) -> Column:
    """A document's place in the cache tree: the key with ``:`` as folder separator."""
    return F.concat(F.replace(c, F.lit(":"), F.lit("/")), F.lit(".json"))


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def any_of(array: Column, test) -> Column:
    """Whether any element passes; false for a null or empty array."""
    return F.coalesce(F.exists(array, test), F.lit(False))
