"""Delivery metrics of a page: response headers and whole-markup signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.functions.text import count_of, occurrences

# Markers of lazy loading; the first two are all that is tested without a good response.
LAZY_MARKERS = ('loading="lazy"', "data-lazy", "lazyload", "lozad")
REDUCED_LAZY_MARKERS = LAZY_MARKERS[:2]
# Encodings by the substring that reveals them, first match wins.
ENCODINGS = (("br", "brotli"), ("gzip", "gzip"), ("deflate", "deflate"))
_PERFORMANCE_STATUS = "perf_status"


def _header(name: str) -> Column:
    """Header value, null when absent or empty; header names are lower case."""
    return F.nullif(F.try_element_at("headers", F.lit(name)), F.lit(""))


def contains_any(html: Column, markers: tuple[str, ...]) -> Column:
    found = F.contains(html, F.lit(markers[0]))
    for marker in markers[1:]:
        found = found | F.contains(html, F.lit(marker))
    return found


def _answered(columns: list[str]) -> tuple[Column, Column]:
    """Whether the timing request got a good answer, and whether it got any (status 0 means none)."""
    if _PERFORMANCE_STATUS not in columns:
        return F.lit(True), F.lit(True)
    status = F.coalesce(F.col(_PERFORMANCE_STATUS), F.lit(0))
    return status.between(200, 299), status != 0


def performance_metrics(html: Column, columns: list[str]) -> list[Column]:
    """Delivery columns of a crawl row, null for pages that were not fetched.

    Without a good answer to the timing request the raw encoding is kept and only the reduced lazy
    test is made; without any answer the headers count as absent.
    """
    usable = F.col("usable")
    good, any_answer = _answered(columns)
    encoding = F.when(any_answer, _header("content-encoding"))
    named = F.coalesce(*[F.when(F.contains(encoding, F.lit(part)), F.lit(name)) for part, name in ENCODINGS])
    cache = F.when(any_answer, _header("cache-control"))
    expires = F.when(any_answer, _header("expires"))
    dense = F.coalesce(F.try_divide(count_of(html, "><[^/]"), occurrences(html, "<")) > 0.5, F.lit(False))
    lazy = F.when(good, contains_any(html, LAZY_MARKERS)).otherwise(contains_any(html, REDUCED_LAZY_MARKERS))
    return [
        F.when(usable, encoding.isNotNull()).alias("compression"),
        F.when(usable, F.when(good, named).otherwise(encoding)).alias("compression_type"),
        F.when(usable, cache.isNotNull() | expires.isNotNull()).alias("cache_headers"),
        F.when(usable, cache).alias("cache_control"),
        F.when(usable, F.when(good, dense).otherwise(False)).alias("minified"),
        F.when(usable, lazy).alias("has_lazy_loading"),
    ]
