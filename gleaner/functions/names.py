"""Names of system tags, built and read back as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the names of system tags begin with, and what stands inside them.
SYSTEM_SOURCE = "System generated"
IN_TAGGABLE_SERVICE = "system:in local taggable service:"
HAS_METRIC_OF_SERVICE = "system:has metric from local metric service:"
HAS_METRIC = "system:has local metric:"
APPLIED_METRIC = "system:applied metric:"
HAS_EXTENSION = "system:has file extension:"
HAS_HASH = "system:has file hash:"
HAS_URL = "system:has url:"
HAS_URL_ASSOCIATION = "system:has url with association:"
FROM_PARSER = "system:is from local url parser:"
URL_SEPARATOR = " with\x01 "
VIDEO = [".mp4", ".webm", ".mkv"]
IMAGE = [".jpg", ".jpeg", ".tif", ".tiff", ".png", ".gif", ".bmp", ".svg", ".webp", ".raw", ".kra", ".psd", ".xcf", ".avif", ".jxl"]


def extension(c: Column) -> Column:
    """Lower case; .jpeg is .jpg and .tiff is .tif."""
    low = F.lower(c)
    return F.when(low == ".jpeg", ".jpg").when(low == ".tiff", ".tif").otherwise(low)


def of_extension(c: Column) -> Column:
    return F.concat(F.lit(HAS_EXTENSION), extension(c))


def of_hash(c: Column) -> Column:
    return F.concat(F.lit(HAS_HASH), F.lower(c))


def of_url(c: Column) -> Column:
    return F.concat(F.lit(HAS_URL), c)


def of_url_association(url: Column, association: Column) -> Column:
    return F.concat(F.lit(HAS_URL_ASSOCIATION), url, F.lit(URL_SEPARATOR), association)


def url_association(c: Column) -> tuple[Column, Column]:
    """(url, association) of such a name; null for other names."""
    parts = F.split(F.substr(c, F.lit(len(HAS_URL_ASSOCIATION) + 1)), URL_SEPARATOR)
    is_it = c.startswith(HAS_URL_ASSOCIATION)
    return F.when(is_it, F.get(parts, F.lit(0))), F.when(is_it, F.get(parts, F.lit(1)))


def of_service(c: Column) -> Column:
    return F.concat(F.lit(IN_TAGGABLE_SERVICE), c.cast("string"))


def service(c: Column) -> Column:
    return F.when(c.startswith(IN_TAGGABLE_SERVICE), F.substr(c, F.lit(len(IN_TAGGABLE_SERVICE) + 1)).cast("long"))


def of_metric(c: Column) -> Column:
    return F.concat(F.lit(HAS_METRIC), c.cast("string"))


def of_metric_service(c: Column) -> Column:
    return F.concat(F.lit(HAS_METRIC_OF_SERVICE), c.cast("string"))


def of_parser(c: Column) -> Column:
    return F.concat(F.lit(FROM_PARSER), c.cast("string"))


def number(c: Column) -> Column:
    """A number as it is written in names: whole ones without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def of_applied(value: Column, metric: Column, user: Column) -> Column:
    """SYS stands for the system, a null user."""
    return F.concat(F.lit(APPLIED_METRIC), number(value), F.lit(" on "), metric.cast("string"), F.lit(" with user "), F.coalesce(user.cast("string"), F.lit("SYS")))


def applied(c: Column) -> tuple[Column, Column, Column]:
    """(value, metric, user) of such a name; nulls for other names, and for the system as user."""
    parts = [F.regexp_extract(c, rf"^{APPLIED_METRIC}(\S+) on (\d+) with user (\d+|SYS)$", k) for k in (1, 2, 3)]
    return parts[0].try_cast("double"), parts[1].try_cast("long"), parts[2].try_cast("long")


def storage_path(hash_hex: Column, name: Column) -> Column:
    """Where a file with this hash is kept: two levels of folders of two hex digits."""
    return F.concat_ws("/", F.substring(hash_hex, 1, 2), F.substring(hash_hex, 3, 2), name)


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)


def now() -> Column:
    """Seconds since 1970, as of the query's start."""
    return F.unix_timestamp()


def bound(c: Column) -> Column:
    """A metric's bound; none if it isn't finite."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def valid_metric(lower: Column, upper: Column, precision: Column, value: Column) -> Column:
    """Whether a value lies in a metric's bounds and the precision is from 0 to 10."""
    low, high = bound(lower), bound(upper)
    return precision.between(0, 10) & (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))


def matches_url(pattern: str, c: Column) -> Column:
    """Whether a URL classifier's pattern finds the URL."""
    return c.rlike(pattern)


def has_prefix(c: Column, prefixes: list[str], case: bool = True) -> Column:
    v = c if case else F.lower(c)
    return F.exists(F.array(*(F.lit(p if case else p.lower()) for p in prefixes)), lambda p: F.startswith(v, p))


def has_suffix(c: Column, suffixes: list[str], case: bool = True) -> Column:
    v = c if case else F.lower(c)
    return F.exists(F.array(*(F.lit(p if case else p.lower()) for p in suffixes)), lambda p: F.endswith(v, p))
