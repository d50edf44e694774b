"""Sitemap files of any size, read in ranges of bytes.

A table with one document per row holds a document in one value. Here files are cut behind every ``</loc>`` by the text
source, which splits them over tasks; every piece is parsed by itself, and a document counts only if all its pieces fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.functions.text import let
from webgauge.operators.sitemaps import ROOT_PATTERN, XML_ENTRIES, first_locations
from webgauge.session import materialize

CUT = "</loc>"
#: What closes a document, and a root element without content.
_END = r"</(?:urlset|sitemapindex)\s*>|<(?:urlset|sitemapindex)(?:\s[^>]*)?/>"


def _open_and_close(kind: Column) -> tuple[Column, Column]:
    """What stands open at a cut, to put before a piece, and what closes it."""
    index = kind.eqNullSafe("sitemapindex")
    return (
        F.when(index, "<sitemapindex><sitemap><loc></loc>").otherwise("<urlset><url><loc></loc>"),
        F.when(index, "</loc></sitemap></sitemapindex>").otherwise("</loc></url></urlset>"),
    )


def read_sitemap_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, root, locs``: the locations of every well-formed sitemap file, in several rows per file.

    The same locations as ``listed_locations`` finds in whole documents: the first one of each entry, without blank
    ones. A file is left out whole if a piece is malformed, if its root element is not where the file begins or
    not closed where it ends, or if it holds entries of the other kind. Files without any ``</loc>`` are one
    piece. A ``</loc>`` that does not end a location of an entry (inside a comment, a CDATA section or another element)
    makes a file count as malformed. Compressed files are read by one task each, still piece by piece.
    """
    read = spark.read.option("lineSep", CUT).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    text = F.col("value")
    named = F.regexp_extract(text, ROOT_PATTERN, 1)
    pieces = read.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), text, named.alias("root"))
    pieces = pieces.withColumns({"head": F.col("root").isin("urlset", "sitemapindex"), "tail": text.rlike(_END)})
    closed = F.when(F.contains(text, F.lit("</sitemap")), "sitemapindex").when(F.contains(text, F.lit("</url")), "urlset")
    pieces = pieces.withColumn("kind", F.when(F.col("head"), F.col("root")).otherwise(closed))
    before, behind = _open_and_close(F.col("kind"))
    whole = F.concat(F.when(F.col("head"), "").otherwise(before), text, F.when(F.col("tail"), "").otherwise(behind))

    def entries(xml: Column) -> Column:
        both = F.when(F.col("kind").eqNullSafe("sitemapindex"), xml["sitemap"]["loc"]).otherwise(xml["url"]["loc"])
        # The first entry of a later piece is the rest of one that began before it.
        fresh = F.when(F.col("head"), both).otherwise(F.slice(both, 2, F.greatest(F.size(both), F.lit(1))))
        return F.when(xml["_corrupt_record"].isNull(), F.coalesce(first_locations(fresh), F.array().cast("array<string>")))

    parsed = materialize(pieces.select("file", "place", "head", "tail", "kind", let(F.from_xml(whole, XML_ENTRIES), entries).alias("locs")))
    ends = parsed.groupBy("file").agg(
        F.count_if("head").alias("heads"),
        F.count_if("tail").alias("tails"),
        F.count_if(F.col("locs").isNull()).alias("odd"),
        F.min("place").alias("first"),
        F.max("place").alias("last"),
        F.max(F.when(F.col("head"), F.col("place"))).alias("head"),
        F.max(F.when(F.col("tail"), F.col("place"))).alias("tail"),
        F.min("kind").alias("root"),
        F.max("kind").alias("other"),
    )
    fits = (F.col("heads") == 1) & (F.col("tails") == 1) & (F.col("odd") == 0) & (F.col("root") == F.col("other"))
    good = ends.where(fits & (F.col("head") == F.col("first")) & (F.col("tail") == F.col("last")))
    return parsed.where(F.size("locs") > 0).join(good.select("file", "root"), "file").select("file", "root", "locs")


def listed_in_files(spark: SparkSession, path: str | list[str], files: DataFrame) -> DataFrame:
    """``site, sitemap_url, root, locs`` of the files under ``path`` that ``files`` (file, site, sitemap_url) names.

    ``file`` is the path as Spark gives it in ``_metadata.file_path``. For the ``listed`` parameter of the sitemap operators.
    """
    return materialize(read_sitemap_files(spark, path).join(files, "file").select("site", "sitemap_url", "root", "locs"))
